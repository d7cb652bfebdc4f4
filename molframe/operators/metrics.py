"""Distributions of family sizes, UMI counts and yields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.dna import flipped, molecule_base
from molframe.functions.namehash import name_hash
from molframe.functions.rejections import COUNTED, COUNTER, SIMPLEX
from molframe.operators import calls


def size_distribution(sizes: DataFrame, size: str = "size", named: str = "family_size") -> DataFrame:
    """(size, count, fraction, fraction of families of this size or larger). One row per distinct size: a small table from the group-by on."""
    counts = sizes.groupBy(F.col(size).cast("long").alias(named)).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    upwards = Window.orderBy(F.col(named).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(named, "count", (F.col("count") / total).alias("fraction"), (F.sum("count").over(upwards) / total).alias(f"fraction_gt_or_eq_{named}"))


def size_distributions(kinds: dict[str, DataFrame], size: str = "size") -> DataFrame:
    """Counts, fractions and cumulative fractions of several kinds of families (a table of sizes each) side by side."""
    rows = None
    for name, sizes in kinds.items():
        one = sizes.groupBy(F.col(size).cast("long").alias("family_size")).agg(F.count("*").alias(f"{name}_count"))
        rows = one if rows is None else rows.join(one, "family_size", "full_outer")
    rows = rows.fillna(0)
    upwards = Window.orderBy(F.col("family_size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for name in kinds:
        total = F.sum(f"{name}_count").over(Window.partitionBy())
        rows = rows.withColumn(f"{name}_fraction", F.coalesce(F.try_divide(f"{name}_count", total), F.lit(0.0))).withColumn(f"{name}_fraction_gt_or_eq_size", F.coalesce(F.try_divide(F.sum(f"{name}_count").over(upwards), total), F.lit(0.0)))
    return rows


def grouping_summary(sizes: DataFrame, size: str = "size") -> DataFrame:
    """Families, reads, mean, median (the first size whose running count is half of all), least and greatest."""
    counts = sizes.groupBy(F.col(size).cast("long").alias("s")).agg(F.count("*").alias("c"))
    run, total = F.sum("c").over(Window.orderBy("s")), F.sum("c").over(Window.partitionBy())
    return counts.withColumn("half", run * 2 >= total).agg(
        F.sum("c").alias("families"), F.sum(F.col("s") * F.col("c")).alias("reads"), (F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean_size"), F.min(F.when(F.col("half"), F.col("s"))).alias("median_size"), F.min("s").alias("min_size"), F.max("s").alias("max_size")
    )


def strand_sizes(reads: DataFrame, molecule: list[str], strand: str = "strand") -> DataFrame:
    """(molecule, ab_size, ba_size) with the larger strand first."""
    rows = reads.groupBy(*molecule).agg(F.count_if(F.col(strand) == "A").alias("a"), F.count_if(F.col(strand) == "B").alias("b"))
    return rows.select(*molecule, F.greatest("a", "b").alias("ab_size"), F.least("a", "b").alias("ba_size"))


def dominance(strands: DataFrame) -> DataFrame:
    """(ab_size, ba_size, count, fraction, fraction of molecules at least as large on both strands), on the small table of distinct size pairs."""
    counts = strands.groupBy("ab_size", "ba_size").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    rows = counts.withColumn("total", total)
    above = counts.select(F.col("ab_size").alias("a"), F.col("ba_size").alias("b"), F.col("count").alias("c"))
    joined = rows.join(above, (F.col("a") >= F.col("ab_size")) & (F.col("b") >= F.col("ba_size")))  # distinct sizes, not families
    return joined.groupBy("ab_size", "ba_size", "count", "total").agg(F.sum("c").alias("up")).select("ab_size", "ba_size", "count", (F.col("count") / F.col("total")).alias("fraction"), (F.col("up") / F.col("total")).alias("fraction_gt_or_eq_size"))


def umi_counts(reads: DataFrame, umi: str, consensus: str, molecule: list[str]) -> DataFrame:
    """By consensus UMI: raw observations, those that differ from it, molecules, and fractions."""
    rows = reads.groupBy(F.col(consensus).alias("umi")).agg(F.count("*").alias("raw_observations"), F.count_if(F.col(umi) != F.col(consensus)).alias("raw_observations_with_errors"), F.count_distinct(*molecule).alias("unique_observations"))
    all_ = Window.partitionBy()
    return rows.withColumn("fraction_raw_observations", F.col("raw_observations") / F.sum("raw_observations").over(all_)).withColumn("fraction_unique_observations", F.col("unique_observations") / F.sum("unique_observations").over(all_))


def observed_umis(kinds: DataFrame, family: list[str], umi: str) -> DataFrame:
    """(family, umi, raw, wrong): each family's consensus UMI, its reads, and those with another UMI, of kinds (family, umi as it was read, n)."""
    rows = kinds.select(*family, F.upper(umi).alias("seq"), F.col(umi).alias("text"), "n").repartition(family[0])
    return calls.families(rows, family, calls.observed_step(family), calls.named(rows, family) + ", umi string, raw bigint, wrong bigint", ("seq",))


def observed_counts(observed: DataFrame, molecule: str) -> DataFrame:
    """umi_counts of observed_umis."""
    rows = observed.groupBy("umi").agg(F.sum("raw").alias("raw_observations"), F.sum("wrong").alias("raw_observations_with_errors"), F.count_distinct(molecule).alias("unique_observations"))
    all_ = Window.partitionBy()
    return rows.withColumn("fraction_raw_observations", F.col("raw_observations") / F.sum("raw_observations").over(all_)).withColumn("fraction_unique_observations", F.col("unique_observations") / F.sum("unique_observations").over(all_))


def expected_dual(duplex: DataFrame, single: DataFrame) -> DataFrame:
    """duplex UMI counts with the fraction expected of independent halves."""
    f = lambda n: single.select(F.col("umi").alias(f"half{n}"), F.col("fraction_unique_observations").alias(f"f{n}"))
    rows = duplex.withColumn("half1", F.substring_index("umi", "-", 1)).withColumn("half2", F.substring_index("umi", "-", -1))
    rows = rows.join(f(1), "half1", "left").join(f(2), "half2", "left")
    return rows.withColumn("fraction_unique_observations_expected", F.coalesce("f1", F.lit(0.0)) * F.coalesce("f2", F.lit(0.0))).drop("half1", "half2", "f1", "f2")


FRACTIONS = tuple(round(0.05 * i, 2) for i in range(1, 21))


def nested_sizes(reads: DataFrame, molecule: list[str], place: Column, counts: dict[str, Column]) -> DataFrame:
    """(molecule, fraction, a column for each of counts: the reads for which its condition holds) of each of the twenty nested subsets in which a molecule has reads; place is from 0 to 1, and a read is in every fraction not below it.

    Reads are counted once, by molecule and by the first fraction they are in; running totals make the twenty subsets of a molecule."""
    first = sum((F.when(place > f, 1).otherwise(0) for f in FRACTIONS), F.lit(0))
    rows = reads.select(*molecule, first.alias("first_"), *[test.alias(f"test_{name}") for name, test in counts.items()])
    own = rows.groupBy(*molecule).agg(*[F.count_if((F.col("first_") == i) & F.col(f"test_{name}")).alias(f"{name}_{i}") for name in counts for i in range(len(FRACTIONS))])
    upto = lambda name, i: sum((F.col(f"{name}_{j}") for j in range(1, i + 1)), F.col(f"{name}_0")).alias(name)
    rows = own.select(*molecule, F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), *[upto(name, i) for name in counts]) for i, f in enumerate(FRACTIONS)])).alias("x")).select(*molecule, "x.*")
    return rows.filter(sum((F.col(name) for name in counts), F.lit(0)) > 0)


def simplex_yield(sizes: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """sizes (by, n: reads of a family): reads, families, their mean size, those of one read and those of `least` or more."""
    n = F.col("n")
    return sizes.groupBy(*by).agg(
        F.sum("n").alias("read_pairs"), F.count("*").alias("ss_families"), (F.sum("n") / F.count("*")).alias("mean_ss_family_size"), F.count_if(n == 1).alias("ss_singletons"), (F.count_if(n == 1) / F.count("*")).alias("ss_singleton_fraction"), F.count_if(n >= least).alias("ss_consensus_families")
    )


def name_place(name: Column) -> Column:
    """Where a template stands among the nested subsets: by the hash of its name, from 0 to 1."""
    return F.abs(name_hash(name).cast("long")) / F.lit(2**31 - 1)


def eligible(reads: DataFrame, cd: str | None = None) -> DataFrame:
    """Templates that count in metrics: both reads primary, paired and mapped (paired, r1_mapped, r2_mapped). Consensus reads (with depth in the column cd) are an error."""
    if cd is not None:
        reads = reads.filter(F.when(F.col(cd).isNotNull(), F.raise_error(F.lit("consensus reads have no families to count"))).otherwise(True))
    return reads.filter(F.col("paired") & F.col("r1_mapped") & F.col("r2_mapped"))


def simplex_metrics(reads: DataFrame, position: list[str], mi: str = "mi", umi: str = "rx", name: str = "qname", least: int = 1) -> dict[str, DataFrame]:
    """family_sizes, umi_counts and yields of templates with molecule ids of one strand. Molecules with reads of both strands (/A and /B) are an error: they are for duplex_metrics."""
    # only ids of a strand meet
    stranded = reads.filter(F.substring(mi, -2, 2).isin("/A", "/B"))
    both = stranded.groupBy(molecule_base(F.col(mi)).alias("molecule")).agg(F.bool_or(F.substring(mi, -1, 1) == "A").alias("a"), F.bool_or(F.substring(mi, -1, 1) == "B").alias("b")).filter("a AND b")
    if not both.isEmpty():
        raise ValueError("molecules have reads of both strands")
    sizes = lambda keys: reads.groupBy(*keys).agg(F.count("*").alias("size"))
    # reads without a molecule have no consensus
    observed = observed_umis(reads.groupBy(mi, umi).agg(F.count("*").alias("n")), [mi], umi)
    observed = observed.withColumn("umi", F.when(F.col(mi).isNotNull(), F.col("umi"))).withColumn("wrong", F.when(F.col(mi).isNotNull(), F.col("wrong")).otherwise(0))
    yields = simplex_yield(nested_sizes(reads, [mi], name_place(F.col(name)), {"n": F.lit(True)}), ["fraction"], least)
    return {"family_sizes": size_distributions({"cs": sizes(position), "ss": sizes([mi])}), "umi_counts": observed_counts(observed, mi), "yield": yields}


def duplex_metrics(reads: DataFrame, position: list[str], mi: str = "mi", umi: str = "rx", name: str = "qname", r1_forward: str = "r1_forward", min_ab: int = 1, min_ba: int = 1) -> dict[str, DataFrame]:
    """family_sizes (cs, ss, ds), duplex_family_sizes, umi_counts of halves, duplex_umi_counts and yields of templates whose molecule ids end in /A or /B. The halves of a dual UMI are named by the strand of the first read, so that
    those of both strands of a molecule meet."""
    rows = reads.withColumn("molecule", molecule_base(F.col(mi))).withColumn("strand", F.regexp_extract(mi, "/([AB])$", 1))
    sizes = lambda keys: rows.groupBy(*keys).agg(F.count("*").alias("size"))
    strands = strand_sizes(rows, ["molecule"])
    turned = F.when(F.col(r1_forward), F.col(umi)).otherwise(flipped(F.col(umi)))
    kinds = rows.filter(F.col("molecule").isNotNull()).groupBy("molecule", turned.alias("turned")).agg(F.count("*").alias("n"))
    halves = kinds.select("molecule", "n", F.posexplode(F.split("turned", "-")).alias("half", "half_umi")).groupBy("molecule", "half", "half_umi").agg(F.sum("n").alias("n"))
    of_half = observed_umis(halves, ["molecule", "half"], "half_umi")
    single = observed_counts(of_half, "molecule")
    both = of_half.groupBy("molecule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("half", "umi"))), lambda x: x["umi"]), "-").alias("umi"))  # two halves
    dual = observed_counts(kinds.join(both, "molecule").select("molecule", "umi", F.col("n").alias("raw"), F.when(F.col("turned") != F.col("umi"), F.col("n")).otherwise(0).alias("wrong")), "molecule")
    nested = nested_sizes(rows, ["molecule"], name_place(F.col(name)), {"a": F.col("strand") == "A", "b": F.col("strand") == "B"})
    return {
        "family_sizes": size_distributions({"cs": sizes(position), "ss": sizes([mi]), "ds": sizes(["molecule"])}), "duplex_family_sizes": dominance(strands), "umi_counts": single,
        "duplex_umi_counts": expected_dual(dual, single), "yield": duplex_yield(nested, ["fraction"], min_ab, min_ba),
    }


def binomial_both(n: int, a: int, b: int) -> float:
    """Probability that of n fair draws a or more fall on one named side and b or more on the other."""
    return sum(math.comb(n, k) for k in range(a, n - b + 1)) / 2**n if n >= a + b else 0.0


def duplex_yield(sizes: DataFrame, by: list[str], min_ab: int = 1, min_ba: int = 1) -> DataFrame:
    """sizes (by, a, b: reads of a molecule on each strand): families, duplexes and the fraction of duplexes to expect of fair strands."""
    n = F.col("a") + F.col("b")
    # P(min_ab <= A <= n - min_ba): the terms are few for the defaults, 1 - 2 / 2^n
    ideal = F.when(n < min_ab + min_ba, 0.0).otherwise(1 - (sum_tail(n, min_ab) + sum_tail(n, min_ba)) / F.pow(F.lit(2.0), n))
    big, small = F.greatest("a", "b"), F.least("a", "b")
    return sizes.groupBy(*by).agg(
        F.count("*").alias("ds_families"),
        F.sum(F.when(F.col("a") > 0, 1).otherwise(0) + F.when(F.col("b") > 0, 1).otherwise(0)).alias("ss_families"),
        F.count_if((big >= min_ab) & (small >= min_ba)).alias("ds_duplexes"),
        (F.count_if((big >= min_ab) & (small >= min_ba)) / F.count("*")).alias("ds_fraction_duplexes"),
        (F.sum(ideal) / F.count("*")).alias("ds_fraction_duplexes_ideal"),
    )


def sum_tail(n: Column, least: int) -> Column:
    """Sum of binomial coefficients n over k for k below least."""
    out, term = F.lit(0.0), F.lit(1.0)
    for k in range(least):
        out = out + term
        term = term * (n - k) / (k + 1)
    return out


def consensus_statistics(reads: DataFrame, reason: str, consensus: DataFrame, always: tuple[str, ...] = SIMPLEX) -> DataFrame:
    """(key, value as text) in the order of the table: reads considered, rejected and used, their fraction, rejected ones by reason (those of `always`, and others if there are any), consensus reads emitted. reason is null for reads that were used."""
    named = F.create_map(*[F.lit(x) for pair in COUNTER.items() for x in pair])
    counts = reads.groupBy(named[F.col(reason)].alias("counter"), F.col(reason).isNotNull().alias("out")).agg(F.count("*").alias("n"))
    emitted = consensus.agg(F.count("*").alias("emitted"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("out"), F.col("n"))), F.lit(0)).alias("gone"), *[F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTED])
    one = total.crossJoin(emitted)  # a row each
    row = lambda place, key, value, shown=None: F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), value.cast("string").alias("value"), (F.lit(True) if shown is None else shown).alias("shown"))
    used = F.col("all") - F.col("gone")
    order = [*always, *[c for c in COUNTED if c not in always]]
    rows = [row(0, "raw_reads_considered", F.col("all")), row(1, "raw_reads_rejected", F.col("gone")), row(2, "raw_reads_used", used), row(3, "frac_raw_reads_used", F.coalesce(F.try_divide(used, F.col("all")), F.lit(0.0)))]
    rows += [row(4 + i, f"raw_reads_rejected_for_{c}", F.col(c), F.lit(c in always) | (F.col(c) > 0)) for i, c in enumerate(order)]
    rows.append(row(4 + len(order), "consensus_reads_emitted", F.col("emitted")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("shown").select("place", "key", "value")
