"""Tags that an alignment implies (NM, MD, UQ), and base corrections that need the reference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.align import REVERSE, has
from molframe.functions.bind import let
from molframe.functions.phred import LEAST


def implied(ops: list[tuple[str, int]], seq: str, qual: list[int] | None, ref: str) -> tuple[int, str, int]:
    """(NM, MD, UQ) of a read whose alignment covers ref: edits, the mismatch string, and the sum of qualities at mismatches."""
    at = place = edits = uq = run = 0
    md = ""
    for op, n in ops:
        if op in "M=X":
            for k in range(n):
                if seq[at + k].upper() == ref[place + k].upper():
                    run += 1
                else:
                    md, run, edits = f"{md}{run}{ref[place + k].upper()}", 0, edits + 1
                    uq += qual[at + k] if qual else 0
            at, place = at + n, place + n
        elif op == "I":
            at, edits = at + n, edits + n
        elif op == "D":
            md, run = f"{md}{run}^{ref[place : place + n].upper()}", 0
            place, edits = place + n, edits + n
        elif op == "N":
            place += n
        elif op == "S":
            at += n
    return edits, f"{md}{run}", uq


def alignment_tags(reads: DataFrame, ref: str = "ref_slice") -> DataFrame:
    """reads (ops, seq, qual and the reference bases their alignments cover) with nm, md and uq; null where the read has no alignment. Walking a CIGAR is irregular, so it runs in Arrow batches."""

    @F.pandas_udf("nm int, md string, uq int")
    def tags(ops: pd.Series, seq: pd.Series, qual: pd.Series, slices: pd.Series) -> pd.DataFrame:
        rows = [implied([(o["op"], o["len"]) for o in x], s, None if q is None else list(q), r) if x is not None and len(x) and r is not None else (None, None, None) for x, s, q, r in zip(ops, seq, qual, slices, strict=True)]
        return pd.DataFrame(rows, columns=["nm", "md", "uq"]).astype({"nm": "Int32", "uq": "Int32"})

    return reads.withColumn("t_", tags("ops", "seq", "qual", ref)).select(*reads.columns, "t_.*")


def restore_unconverted(seq: Column, ref: Column, flag: Column, strand: Column) -> Column:
    """seq with converted bases put back: ref has the reference base under each base of seq (any other sign where there is none); strand f or r is the bisulfite strand. On the strand as written
    T becomes C at reference C, or A becomes G at reference G."""
    as_c = (strand == "f") != has(flag, REVERSE)

    def one(base: Column, under: Column) -> Column:
        c = as_c & (F.upper(under) == "C") & (F.upper(base) == "T")
        g = ~as_c & (F.upper(under) == "G") & (F.upper(base) == "A")
        return F.when(c, "C").when(g, "G").otherwise(base)

    return F.when(strand.isin("f", "r"), F.array_join(F.zip_with(F.split(seq, ""), F.split(ref, ""), one), "")).otherwise(seq)


def mask_strand_methylation(reads: DataFrame, ref: str = "ref", top: tuple[str, str] = ("au", "at"), bottom: tuple[str, str] = ("bu", "bt")) -> DataFrame:
    """Both bases of a CpG are masked where the strands' evidence (unconverted, converted) calls it methylated on one strand only."""
    i = F.sequence(F.lit(0), F.length("seq") - 1)
    sign = lambda k: F.substring(ref, (k + 1).cast("int"), F.lit(1))
    of = lambda c, k: F.coalesce(F.get(F.col(c), k.cast("int")), F.lit(0))

    def unlike(k: Column) -> Column:
        """The CpG that begins at k."""
        u, c, v, w = of(top[0], k), of(top[1], k), of(bottom[0], k + 1), of(bottom[1], k + 1)
        return (k >= 0) & (sign(k) == "C") & (sign(k + 1) == "G") & (u + c > 0) & (v + w > 0) & ((u > c) != (v > w))

    tests = F.transform(i, lambda k: F.coalesce(unlike(k) | unlike(k - 1), F.lit(False)))
    out = reads.withColumn("tests_", tests)
    bases = F.split("seq", "")
    new = F.array_join(F.zip_with(bases, "tests_", lambda b, t: F.when(t, F.lit("N")).otherwise(b)), "")
    return out.withColumn("newly", F.size(F.filter(F.zip_with(bases, "tests_", lambda b, t: t & (b != "N")), lambda x: x))).withColumn("qual", F.zip_with("qual", "tests_", lambda q, t: F.when(t, LEAST).otherwise(q))).withColumn("seq", new).drop("tests_")


def modified_bases(seq: Column, modified: Column, probability: Column, base: str = "C", code: str = "m") -> Column:
    """struct<mm, ml>: the modified bases of a read (array<boolean> and array<int> from 0 to 255, by place) as a delta text, `C+m,` and how many bases of the kind are passed over before each, and their probabilities; null where none is modified."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0))), lambda i: F.substring(seq, i + 1, F.lit(1)) == base)
    start = F.struct(F.lit(0).alias("passed"), F.array().cast("array<int>").alias("deltas"), F.array().cast("array<int>").alias("ml"))

    def step(s: Column, i: Column) -> Column:
        hit = F.coalesce(F.get(modified, i), F.lit(False))
        return F.struct(
            F.when(hit, 0).otherwise(s["passed"] + 1).alias("passed"),
            F.when(hit, F.concat(s["deltas"], F.array(s["passed"]))).otherwise(s["deltas"]).alias("deltas"),
            F.when(hit, F.concat(s["ml"], F.array(F.get(probability, i)))).otherwise(s["ml"]).alias("ml"),
        )

    def text(x: Column) -> Column:
        return F.when(F.size(x["deltas"]) > 0, F.struct(F.concat(F.lit(f"{base}+{code},"), F.array_join(x["deltas"].cast("array<string>"), ","), F.lit(";")).alias("mm"), x["ml"].alias("ml")))

    return let(F.aggregate(places, start, step), text)
