"""Seeded synthetic reads with their truth, made by hashes of row numbers, so that any part can be made anywhere and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1, by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(uniform(seed, *keys), F.lit(1e-300)))) * F.cos(F.lit(6.283185307179586) * uniform(seed + 1, *keys))


def letters(seed: int, length: int, *keys: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform(seed, i, *keys) * 4) + 1).cast("int"), F.lit(1))), "")


def family_size(seed: int, key: Column, mean: float = 3.0, spread: float = 0.6) -> Column:
    """Log-normal sizes of 1 and more."""
    return F.greatest(F.lit(1), F.round(F.exp(normal(seed, key) * spread) * F.lit(mean))).cast("int")


def gamma(seed: int, shape: int, *keys: Column) -> Column:
    """A gamma variate of whole-number shape and scale 1: a sum of exponentials."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(shape)), F.lit(0.0), lambda s, i: s - F.log(F.greatest(uniform(seed, i, *keys), F.lit(1e-300))))


def poisson(seed: int, mean: Column, *keys: Column, most: int = 1000) -> Column:
    """A Poisson variate up to `most`: the first count whose cumulative probability passes a uniform number."""
    u = uniform(seed, *keys)
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        done = s["done"] | (u <= s["sum"])
        p = s["p"] * mean / i
        return F.struct(F.when(done, s["k"]).otherwise(i).alias("k"), p.alias("p"), (s["sum"] + p).alias("sum"), done.alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(most), (mean * 4 + 30).cast("int"))), start, step)["k"].cast("int")


def negative_binomial_size(seed: int, key: Column, mean: float = 3.0, shape: int = 2) -> Column:
    """Sizes of 1 and more whose excess over 1 is negative binomial: Poisson with a gamma mean."""
    return (poisson(seed + 1, gamma(seed, shape, key) * F.lit((mean - 1) / shape), key) + 1).cast("int")


def empirical_size(seed: int, key: Column, counts: dict[int, int]) -> Column:
    """Sizes as often as a histogram (size: count) has them."""
    total, run, out = sum(counts.values()), 0, F.lit(None).cast("int")
    cuts = []
    for size, n in sorted(counts.items()):
        run += n
        cuts.append((run / total, size))
    u = uniform(seed, key)
    for edge, size in reversed(cuts):
        out = F.when(u <= edge, F.lit(size)).otherwise(out)
    return F.coalesce(out, F.lit(cuts[-1][1]))


def insert_size(seed: int, key: Column, mean: float = 300.0, spread: float = 50.0, least: int = 50, most: int = 1000) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.round(normal(seed, key) * spread + mean))).cast("int")


def strand_bias(seed: int, key: Column, alpha: int = 5, beta: int = 5) -> Column:
    """A molecule's share of strand A: beta, by two gammas."""
    a, b = gamma(seed, alpha, key), gamma(seed + 1, beta, key)
    return a / (a + b)


def mapped_reads(spark: SparkSession, molecules: int, seed: int = 42, length: int = 50, umi: int = 8, contigs: int = 22, unmapped: float = 0.01) -> DataFrame:
    """(mi, qname, segment, tid, pos, reverse, mate_tid, mate_pos, mate_reverse, cigar, mapq, unmapped, rx): both reads of forward-reverse pairs as an aligner would place them, a share of the templates unmapped."""
    key = F.col("mi")
    m = spark.range(molecules).withColumnRenamed("id", "mi").select("mi", F.floor(uniform(seed + 2, key) * contigs).cast("int").alias("tid"), F.floor(uniform(seed + 3, key) * 1_000_000).alias("first"), insert_size(seed + 30, key, least=length).alias("insert"), letters(seed + 4, umi, key).alias("rx"), family_size(seed + 6, key).alias("n"), strand_bias(seed + 32, key).alias("share"))
    t = m.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    of = (key, F.col("i"))
    t = t.withColumn("a", uniform(seed + 7, *of) < F.col("share")).withColumn("lost", uniform(seed + 8, *of) < unmapped).withColumn("last", F.col("first") + F.col("insert") - length)
    out = t.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("segment"))
    forward = F.col("a") == (F.col("segment") == 1)
    placed = lambda c: F.when(~F.col("lost"), c)
    return out.select(
        "mi", F.concat(F.lit("sim:"), "mi", F.lit(":"), "i").alias("qname"), "segment", F.coalesce(placed(F.col("tid")), F.lit(-1)).alias("tid"), F.coalesce(placed(F.when(forward, F.col("first")).otherwise(F.col("last"))), F.lit(-1)).alias("pos"),
        F.coalesce(placed(~forward), F.lit(False)).alias("reverse"), F.coalesce(placed(F.col("tid")), F.lit(-1)).alias("mate_tid"), F.coalesce(placed(F.when(forward, F.col("last")).otherwise(F.col("first"))), F.lit(-1)).alias("mate_pos"),
        F.coalesce(placed(forward), F.lit(False)).alias("mate_reverse"), F.coalesce(placed(F.lit(f"{length}M")), F.lit("*")).alias("cigar"), F.coalesce(placed(F.lit(60)), F.lit(0)).alias("mapq"), F.col("lost").alias("unmapped"), "rx",
    )


def consensus_reads(spark: SparkSession, molecules: int, seed: int = 42, length: int = 50, error: float = 0.01) -> DataFrame:
    """(mi, qname, seq, qual, cD, cM, cE, depths, errors): consensus reads with their tags, of molecules of simulated sizes."""
    key = F.col("mi")
    m = spark.range(molecules).withColumnRenamed("id", "mi").select("mi", letters(seed + 5, length, key).alias("seq"), negative_binomial_size(seed + 6, key, 4.0).alias("n"))
    places = F.sequence(F.lit(0), F.lit(length - 1))
    depths = F.transform(places, lambda at: F.greatest(F.lit(1), F.col("n") - F.when(uniform(seed + 40, at, key) < 0.1, 1).otherwise(0)))
    out = m.withColumn("depths", depths).withColumn("errors", F.transform(F.col("depths"), lambda d, at: F.when(uniform(seed + 41, at, key) < error * d, 1).otherwise(0)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    quals = F.zip_with("depths", "errors", lambda d, e: F.greatest(F.lit(2), F.least(F.lit(90), d * 20 - e * 15)).cast("int"))
    return out.select("mi", F.concat(F.lit("sim:"), "mi").alias("qname"), "seq", quals.alias("qual"), F.array_max("depths").alias("cD"), F.array_min("depths").alias("cM"), (total(F.col("errors")) / total(F.col("depths"))).cast("float").alias("cE"), "depths", "errors")


def correct_reads(spark: SparkSession, reads: int, fixed: list[str], seed: int = 42, mismatches: tuple[float, float, float] = (0.9, 0.08, 0.02)) -> DataFrame:
    """(qname, rx, true_umi, changed): UMIs of a fixed list with 0, 1 or 2 bases changed, at the given shares."""
    key = F.col("id")
    true = F.get(F.array(*[F.lit(u) for u in fixed]), F.floor(uniform(seed, key) * len(fixed)).cast("int"))
    u = uniform(seed + 1, key)
    rows = spark.range(reads).withColumn("true_umi", true).withColumn("changed", F.when(u < mismatches[0], 0).when(u < mismatches[0] + mismatches[1], 1).otherwise(2))
    size = F.length("true_umi")
    first = F.floor(uniform(seed + 2, key) * size).cast("int")
    second = ((first + 1 + F.floor(uniform(seed + 3, key) * (size - 1)).cast("int")) % size).cast("int")
    other = lambda b, i: F.substring(F.lit("ACGTACGT"), (F.instr(F.lit("ACGT"), b) + 1 + F.floor(uniform(seed + 4, key, i) * 3)).cast("int"), F.lit(1))
    rx = F.array_join(F.transform(F.split("true_umi", ""), lambda b, i: F.when(((i == first) & (F.col("changed") >= 1)) | ((i == second) & (F.col("changed") == 2)), other(b, i)).otherwise(b)), "")
    return rows.select(F.concat(F.lit("sim:"), "id").alias("qname"), rx.alias("rx"), "true_umi", "changed")


def grouped_reads(spark: SparkSession, molecules: int, seed: int = 42, length: int = 50, umi: int = 8, error: float = 0.005, strand_bias: float = 0.5) -> DataFrame:
    """(mi, strand, tid, pos, qname, rx, true_umi, seq, true_seq, qual) of molecules with log-normal family sizes, errors at a rate in bases and UMIs, and qualities that fall along the read."""
    m = spark.range(molecules).withColumnRenamed("id", "mi")
    m = m.select("mi", (F.floor(uniform(seed + 2, F.col("mi")) * 22)).cast("int").alias("tid"), F.floor(uniform(seed + 3, F.col("mi")) * 1_000_000).alias("pos"), letters(seed + 4, umi, F.col("mi")).alias("true_umi"), letters(seed + 5, length, F.col("mi")).alias("true_seq"), family_size(seed + 6, F.col("mi")).alias("n"))
    r = m.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    key = (F.col("mi"), F.col("i"))

    def noisy(text: Column, salt: int) -> Column:
        return F.array_join(F.transform(F.split(text, ""), lambda b, at: F.when(uniform(salt, at, *key) < error, F.substring(F.lit("ACGT"), (F.floor(uniform(salt + 1, at, *key) * 4) + 1).cast("int"), F.lit(1))).otherwise(b)), "")

    quals = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda at: F.greatest(F.lit(2), F.least(F.lit(41), F.round(38 - 12 * at / length + 3 * normal(seed + 9, at, *key)))).cast("int"))
    return r.select("mi", F.when(uniform(seed + 7, *key) < strand_bias, "A").otherwise("B").alias("strand"), "tid", "pos", F.concat(F.lit("sim:"), "mi", F.lit(":"), "i").alias("qname"), noisy(F.col("true_umi"), seed + 10).alias("rx"), "true_umi", noisy(F.col("true_seq"), seed + 20).alias("seq"), "true_seq", quals.alias("qual"))


def fastq_reads(spark: SparkSession, molecules: int, structure_umi: int = 8, **options) -> DataFrame:
    """(qname, line): FASTQ records whose reads begin with their UMI, and the truth beside them."""
    rows = grouped_reads(spark, molecules, umi=structure_umi, **options)
    text = F.concat_ws("\n", F.concat(F.lit("@"), "qname"), F.concat("rx", "seq"), F.lit("+"), F.concat(F.lit("I" * structure_umi), F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")))
    return rows.select("qname", text.alias("line"), "true_umi", "mi")
