"""Readers and writers of the domain's text formats, as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.functions.align import cigar, plain_name

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord: the record's number in its file, name, qname, seq, qual) of FASTQ files, plain or compressed as their names say. A record is four lines by their place in the file; reads may be empty. An error if a file's lines are no
    multiple of four, or a record doesn't begin with @ or has no + line.

    Large plain files are read in blocks: lines are counted by block first, then each block makes its whole records where it is, and only the few lines of records that two blocks share meet."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    broken = F.sum("lines").over(Window.partitionBy("file")) % 4 != 0
    base = F.when(broken, F.raise_error(F.concat(F.lit("lines are no multiple of four: "), "file"))).otherwise(F.coalesce(F.sum("lines").over(before), F.lit(0)))
    counts = counts.select("file", "block", "first", (base + F.col("lines")).alias("end"), base.alias("base"))
    placed = lines.join(F.broadcast(counts), ["file", "block"])  # a row for each block of a file, as many as the plan itself lists
    placed = placed.select("file", (F.col("base") + F.col("id") - F.col("first")).alias("n"), "base", "end", "value")
    head, tail = F.ceil(F.col("base") / 4) * 4, F.floor(F.col("end") / 4) * 4

    def whole(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            n = pdf["n"].to_numpy()
            start = np.flatnonzero(n % 4 == 0)
            start = start[start + 3 < len(n)]
            text = pdf["value"].to_numpy()
            yield pd.DataFrame({"file": pdf["file"].to_numpy()[start], "ord": n[start] // 4, **{f"l{k}": text[start + k] for k in range(4)}})
            done = start[-1] + 4 if len(start) else 0
            held = pdf.iloc[done:]

    inside = placed.filter((F.col("n") >= head) & (F.col("n") < tail)).select("file", "n", "value").mapInPandas(whole, "file string, ord long, l0 string, l1 string, l2 string, l3 string")
    shared = placed.filter((F.col("n") < head) | (F.col("n") >= tail)).groupBy("file", F.floor(F.col("n") / 4).alias("ord")).agg(*[F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"l{k}") for k in range(4)])
    rows = inside.unionByName(shared)
    fine = F.startswith("l0", F.lit("@")) & F.startswith("l2", F.lit("+"))
    name = F.when(fine, F.substring("l0", F.lit(2), F.length("l0"))).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), "l0")))
    return rows.select("file", "ord", name.alias("name"), plain_name(name).alias("qname"), F.trim("l1").alias("seq"), F.trim("l3").alias("qual"))


def phred_values(qual: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def phred_text(quals: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(quals, lambda q: F.char(q + offset)), "")


def write_fastq(records: DataFrame, path: str, compression: str | None = None) -> None:
    """records has line, a whole FASTQ record."""
    records.select("line").write.mode("overwrite").option("compression", compression or "none").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text: the eleven fields (pos and pnext 0-based, missing -1), ops, and tags as a map of `TAG` to its value's text."""
    fields = spark.read.text(path).filter(~F.startswith("value", F.lit("@")) & (F.length("value") > 0)).select(F.split("value", "\t").alias("x"))
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    cols = [F.col("x")[i].cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(SAM)]
    tags = F.map_from_entries(F.transform(F.slice("x", F.lit(12), F.greatest(F.size("x") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    kind = F.map_from_entries(F.transform(F.slice("x", F.lit(12), F.greatest(F.size("x") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(4), F.lit(1)).alias("v"))))
    out = fields.select(*cols, tags.alias("tags"), kind.alias("tag_types"))
    out = out.withColumn("pos", F.col("pos") - 1).withColumn("pnext", F.col("pnext") - 1)
    return out.withColumn("ops", F.when(F.col("cigar") != "*", cigar(F.col("cigar"))).otherwise(cigar(F.lit(""))))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(rg, library) of the @RG lines of a SAM header."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit("@RG\t")))
    return lines.select(F.regexp_extract("value", r"\tID:([^\t]*)", 1).alias("rg"), F.regexp_extract("value", r"\tLB:([^\t]*)", 1).alias("library"))


def write_sam(reads: DataFrame, path: str) -> None:
    """reads as read_sam gives them, to SAM record lines."""
    own = [F.coalesce((F.col(n) + 1 if n in ("pos", "pnext") else F.col(n)).cast("string"), F.lit("*")) for n in SAM]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], F.coalesce(F.try_element_at(F.col("tag_types"), e["key"]), F.lit("Z")), e["value"]))
    reads.select(F.concat_ws("\t", *own, F.when(F.size("tags") > 0, F.array_join(tags, "\t"))).alias("value")).write.mode("overwrite").text(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, from, to), 0-based and half-open, of a BED file or of an interval list (@ header, 1-based starts)."""
    lines = spark.read.text(path).withColumn("name", F.input_file_name()).filter(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    listed = lines.filter(F.startswith("value", F.lit("@"))).limit(1).count() > 0
    x = F.split("value", "\t")
    rows = lines.filter(~F.startswith("value", F.lit("@"))).select(x[0].alias("chrom"), x[1].cast("long").alias("from"), x[2].cast("long").alias("to"))
    return rows.withColumn("from", F.col("from") - 1) if listed else rows


def read_variants(spark: SparkSession, path: str, sample: str | None = None, maf: float | None = 0.05) -> DataFrame:
    """(chrom, site 0-based, ref, alt, genotype, filters, maf) of a VCF's single-base variants; those with a minor allele above `maf` are dropped, those without one kept."""
    from molframe.operators.order import genotype, minor_allele

    header = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).first()
    columns = header[0].split("\t") if header else []
    at = columns.index(sample) if sample else 9
    x = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).select(x.alias("x"))
    rows = rows.filter((F.length(F.col("x")[3]) == 1) & F.forall(F.split(F.col("x")[4], ","), lambda a: F.length(a) == 1))
    keys, values = F.split(F.get("x", F.lit(8)), ":"), F.split(F.get("x", F.lit(at)), ":")
    field = lambda k: F.when(F.array_position(keys, k) > 0, F.get(values, (F.array_position(keys, k) - 1).cast("int")))
    gt = field("GT")
    alleles = F.concat(F.array(F.col("x")[3]), F.split(F.col("x")[4], ","))
    letters = F.transform(F.split(gt, "[/|]"), lambda g: F.when(g == ".", ".").otherwise(F.get(alleles, F.expr("try_cast(0 as int)") + g.try_cast("int"))))
    minor = minor_allele(field("AF").try_cast("double"), F.transform(F.split(field("AD"), ","), lambda v: v.try_cast("long")))
    out = rows.select(F.col("x")[0].alias("chrom"), (F.col("x")[1].cast("long") - 1).alias("site"), F.col("x")[3].alias("ref"), F.col("x")[4].alias("alt"), genotype(letters, F.contains(gt, F.lit("|"))).alias("genotype"), F.col("x")[6].alias("filters"), minor.alias("maf"))
    return out.filter(F.col("maf").isNull() | (F.col("maf") <= maf)) if maf is not None else out


#: Bases of a piece of a contig.
PIECE = 10_000


def read_reference_pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(chrom, piece, bases): the contigs of a FASTA file in upper case, in pieces of `size` bases; place p of a contig is in piece p div size."""
    text = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    parts = text.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("bases"))
    pieces = parts.filter(F.length("bases") > 0).select("chrom", F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / size))).alias("piece"), "bases")
    return pieces.select("chrom", "piece", F.expr(f"substring(bases, CAST(piece * {size} + 1 AS INT), {size})").alias("bases"))


def reference_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a FASTA file's contigs: its sequence dictionary."""
    return read_reference_pieces(spark, path).groupBy("chrom").agg(F.sum(F.length("bases")).cast("long").alias("length"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, ref_pos, ref): a row for each base of a FASTA file."""
    rows = read_reference_pieces(spark, path).select("chrom", "piece", F.posexplode(F.split("bases", "")).alias("i", "ref"))
    return rows.filter("ref <> ''").select("chrom", (F.col("piece") * PIECE + F.col("i")).alias("ref_pos"), "ref")


def reference_at(reads: DataFrame, pieces: DataFrame, chrom: str = "chrom", start: str = "pos", length: str = "length", size: int = PIECE) -> DataFrame:
    """reads with ref, the reference's bases from `start` (0-based) over `length` places: the distinct places of reads meet the pieces they touch, one or two for most."""
    places = reads.select(F.col(chrom).alias("c_"), F.col(start).alias("s_"), F.col(length).alias("l_")).distinct()
    span = places.withColumn("p_", F.explode(F.sequence(F.floor(F.col("s_") / size), F.floor((F.col("s_") + F.greatest(F.col("l_"), F.lit(1)) - 1) / size))))
    low = F.greatest(F.col("s_") - F.col("p_") * size, F.lit(0))
    high = F.least(F.col("s_") + F.col("l_") - F.col("p_") * size, F.lit(size))
    met = span.join(pieces, (F.col("c_") == F.col("chrom")) & (F.col("p_") == F.col("piece")))
    cut = met.select("c_", "s_", "l_", "p_", F.substring("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("b_"))
    ref = cut.groupBy("c_", "s_", "l_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_", "b_"))), lambda x: x["b_"]), "").alias("ref"))
    return reads.join(ref, (reads[chrom] == F.col("c_")) & (reads[start] == F.col("s_")) & (reads[length] == F.col("l_")), "left").drop("c_", "s_", "l_")


def read_umi_list(inline: list[str], spark: SparkSession | None = None, paths: tuple[str, ...] = ()) -> list[str]:
    """UMIs given inline and in files: trimmed, upper case, distinct, sorted; an error if lengths differ. A list a person keeps, so it is read to the driver."""
    found = list(inline)
    for path in paths:
        found += [r[0] for r in spark.read.text(path).collect()]
    out = sorted({u.strip().upper() for u in found if u.strip()})
    if len({len(u) for u in out}) > 1:
        raise ValueError("UMIs of the list differ in length")
    return out


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A table of metrics as write_metrics or a tool wrote it: tabs, a line of names, numbers where all values of a column are such; comment lines begin with #."""
    return spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "true").option("comment", "#").csv(path)
