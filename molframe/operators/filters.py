"""Filters and masks of consensus reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.flat import NO_QUALITY, at as value_at, letters, number_column, numbers, places, text_column
from molframe.functions.phred import LEAST

N = ord("N")


def three(values: tuple) -> tuple:
    """One to three thresholds (consensus, better strand, worse strand): the last is repeated."""
    if not 1 <= len(values) <= 3:
        raise ValueError("one to three thresholds")
    return (*values, *[values[-1]] * 2)[:3]


def check_thresholds(min_reads: tuple, max_read_error: tuple, max_base_error: tuple) -> None:
    """An error unless reads fall from the consensus to the better and the worse strand, and error rates rise from the better to the worse strand and lie between 0 and 1."""
    total, better, worse = three(min_reads)
    if not total >= better >= worse >= 0:
        raise ValueError("min reads must not rise from the consensus to the strands")
    for rates in (max_read_error, max_base_error):
        _, good, bad = three(rates)
        if not all(0 <= r <= 1 for r in rates) or good > bad:
            raise ValueError("error rates lie between 0 and 1 and must not fall from the better to the worse strand")


def simplex_reason(depth: Column, error: Column, min_reads: int, max_error: float) -> Column:
    """The first failing test of a consensus read by its depth (cD) and error rate (cE); an error where either is missing."""
    missing = F.raise_error(F.lit("not a consensus read: cD or cE is missing"))
    return F.when(depth.isNull() | error.isNull(), missing).when(depth < min_reads, "insufficient_reads").when(error.cast("double") > max_error, "excessive_error_rate")


def duplex_reason(cd: Column, ce: Column, ad: Column, ae: Column, bd: Column, be: Column, min_reads: tuple = (1,), max_error: tuple = (0.025,)) -> Column:
    """The same for a duplex read: then the better depth and error rate of the strands, each for itself, against the second thresholds and the worse against the third."""
    (r0, r1, r2), (e0, e1, e2) = three(min_reads), three(max_error)
    best_depth = F.greatest(F.coalesce(ad, F.lit(0)), F.coalesce(bd, F.lit(0)))
    worst_depth = F.least(F.coalesce(ad, F.lit(0)), F.coalesce(bd, F.lit(0)))
    best_error, worst_error = F.coalesce(F.least(ae, be), F.lit(0.0)).cast("double"), F.coalesce(F.greatest(ae, be), F.lit(0.0)).cast("double")
    strands = (
        F.when(ad.isNull() & bd.isNull(), None)
        .when(best_depth < r1, "insufficient_reads").when(best_error > e1, "excessive_error_rate")
        .when(worst_depth < r2, "insufficient_reads").when(worst_error > e2, "excessive_error_rate")
    )
    return F.coalesce(simplex_reason(cd, ce, r0, e0), strands)


def _masked(seq: Column, qual: Column, tests: Column) -> tuple[Column, Column, Column]:
    """seq and qual with N at the least quality where tests (array<boolean>) hold, and the bases newly masked."""
    bases = F.split(seq, "")
    new = F.array_join(F.zip_with(bases, tests, lambda b, t: F.when(t, F.lit("N")).otherwise(b)), "")
    quals = F.zip_with(qual, tests, lambda q, t: F.when(t, F.lit(LEAST)).otherwise(q))
    count = F.size(F.filter(F.zip_with(bases, tests, lambda b, t: t & (b != "N")), lambda x: x))
    return new, quals, count


def mask_simplex(reads: DataFrame, min_reads: int, max_base_error: float, min_qual: int | None = None, depths: str = "cd", errors: str = "ce") -> DataFrame:
    """reads with bases masked by quality and, where both per-base tags are there, depth and error rate; newly counts them."""
    rate = lambda x: (x["d"] > 0) & (F.try_divide(x["e"], x["d"]) > max_base_error)
    per_base = F.col(depths).isNotNull() & F.col(errors).isNotNull()
    both = F.arrays_zip(F.col("qual").alias("q"), F.coalesce(F.col(depths), F.array().cast("array<int>")).alias("d"), F.coalesce(F.col(errors), F.array().cast("array<int>")).alias("e"))
    filled = F.transform(both, lambda x: F.struct(x["q"].alias("q"), F.coalesce(x["d"], F.lit(0)).alias("d"), F.coalesce(x["e"], F.lit(0)).alias("e")))
    tests = F.transform(filled, lambda x: (x["q"] < min_qual if min_qual else F.lit(False)) | (per_base & ((x["d"] < min_reads) | rate(x))))
    seq, qual, count = _masked(F.col("seq"), F.col("qual"), tests)
    return reads.withColumn("seq_", seq).withColumn("newly", count).withColumn("qual", qual).withColumn("seq", F.col("seq_")).drop("seq_")


def mask_duplex(reads: DataFrame, min_reads: tuple = (1,), max_base_error: tuple = (0.1,), min_qual: int | None = None, agreement: bool = False) -> DataFrame:
    """The same for duplex reads (ad, ae, bd, be per base; ac, bc the strands' bases): by both strands together, the better and the worse one, and where asked by the strands' bases differing."""
    (r0, r1, r2), (e0, e1, e2) = three(min_reads), three(max_base_error)
    used = ("seq", "qual", "ad", "ae", "bd", "be", "ac", "bc")

    def rate(e: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.divide(e, d, out=np.zeros(len(d)), where=d > 0)

    # all bases of an Arrow batch at a time; a read without one of the columns has no result
    @F.arrow_udf("seq string, qual array<int>, newly int")
    def masked(seq: pa.Array, qual: pa.Array, ad: pa.Array, ae: pa.Array, bd: pa.Array, be: pa.Array, ac: pa.Array, bc: pa.Array) -> pa.Array:
        codes, bounds = letters(seq)
        values, value_bounds = numbers(qual)
        row, place = places(bounds)
        a, ea, b, eb = (value_at(*numbers(x, 0), row, place, 0) for x in (ad, ae, bd, be))
        own, other = rate(ea, a), rate(eb, b)
        bad = (a + b < r0) | (rate(ea + eb, a + b) > e0) | (np.maximum(a, b) < r1) | (np.minimum(own, other) > e1) | (np.minimum(a, b) < r2) | (np.maximum(own, other) > e2)
        if min_qual:
            q = value_at(values, value_bounds, row, place, NO_QUALITY)
            bad |= (q != NO_QUALITY) & (q < min_qual)
        if agreement:
            bad |= (a > 0) & (b > 0) & (value_at(*letters(ac), row, place, N) != value_at(*letters(bc), row, place, N))
        bad &= codes != N
        row_q, place_q = places(value_bounds)
        quals = np.where(value_at(bad, bounds, row_q, place_q, 0) > 0, LEAST, values)
        void = pa.array(np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in (seq, qual, ad, ae, bd, be, ac, bc)]))
        count = pa.array(np.bincount(row[bad], minlength=len(seq)).astype(np.int32))
        made = [text_column(np.where(bad, N, codes), bounds), number_column(quals, value_bounds), count]
        return pa.StructArray.from_arrays([pc.if_else(void, pa.scalar(None, x.type), x) for x in made], ["seq", "qual", "newly"])

    return reads.withColumn("masked_", masked(*used)).withColumns({n: F.col(f"masked_.{n}") for n in ("seq", "newly", "qual")}).drop("masked_")


def no_calls(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def mean_quality(qual: Column) -> Column:
    """Over the full length, to be taken before masking."""
    return F.try_divide(F.aggregate(qual, F.lit(0), lambda s, q: s + q), F.size(qual))


def too_many_no_calls(seq: Column, most: float) -> Column:
    """A fraction of the length where `most` is below 1, else a count."""
    return no_calls(seq) > (F.length(seq) * most if most < 1 else F.lit(int(most)))


def whole_templates(reads: DataFrame, passes: Column, name: str = "qname", is_primary: Column | None = None) -> DataFrame:
    """Reads of templates with a primary read all of whose primary reads pass."""
    kept = F.min(F.when(is_primary if is_primary is not None else F.lit(True), passes)).over(Window.partitionBy(name))
    return reads.withColumn("kept_", kept).filter("kept_").drop("kept_")


def methylation_mask(reads: DataFrame, min_depth: int, unconverted: str = "cu", converted: str = "ct") -> DataFrame:
    """Bases whose methylation evidence (cu + ct) is there but thin are masked."""
    tests = F.zip_with(F.col(unconverted), F.col(converted), lambda u, c: (u + c > 0) & (u + c < min_depth))
    seq, qual, count = _masked(F.col("seq"), F.col("qual"), tests)
    return reads.withColumn("seq_", seq).withColumn("newly", count).withColumn("qual", qual).withColumn("seq", F.col("seq_")).drop("seq_")


def conversion_fraction(ref: Column, unconverted: Column, converted: Column) -> Column:
    """Share of converted evidence at reference C outside CpG; null without any."""
    at = F.sequence(F.lit(0), F.length(ref) - 1)
    inside = F.filter(at, lambda i: (F.substring(ref, i + 1, F.lit(1)) == "C") & (F.substring(ref, i + 2, F.lit(1)) != "G"))
    total = lambda a: F.aggregate(inside, F.lit(0), lambda s, i: s + F.coalesce(F.get(a, i), F.lit(0)))
    return F.try_divide(total(converted), total(converted) + total(unconverted))


def filter_reads(
    reads: DataFrame, min_reads: tuple = (1,), max_read_error: tuple = (0.025,), max_base_error: tuple = (0.1,), min_base_qual: int | None = None, min_mean_qual: float | None = None, max_no_calls: float = 0.2, agreement: bool = False,
    duplex: bool = False, min_methylation_depth: int | None = None, min_conversion: float | None = None, by_template: bool = True, name: str = "qname", is_primary: str | None = None, regenerate=None, per_base: tuple[str, ...] = (),
    depths: str = "cd", errors: str = "ce", min_base_depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole filter in its order: per-base columns turned to the read's strand (per_base), mean quality before masking, base masks, methylation masks, tags made anew (regenerate, a function of a DataFrame), tests of the read, the conversion
    fraction, then whole templates. Returns (reads kept, with newly: the bases masked; and the counts of reads, reads kept and bases masked).

    Reads of simplex consensuses have cD, cE and per base `depths`, `errors` (a base of fewer reads than min_reads, or min_base_depth, is masked); of duplexes also aD, aE, bD, bE and per base ad, ae, bd, be, ac, bc."""
    check_thresholds(min_reads, max_read_error, max_base_error)
    rows = reads
    for c in per_base:
        rows = rows.withColumn(c, F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c)))
    rows = rows.withColumn("mean_", mean_quality(F.col("qual")))
    if duplex:
        rows = mask_duplex(rows, min_reads, max_base_error, min_base_qual, agreement)
        reason = duplex_reason(*[F.col(c) for c in ("cD", "cE", "aD", "aE", "bD", "bE")], min_reads, max_read_error)
    else:
        rows = mask_simplex(rows, min_reads[0] if min_base_depth is None else min_base_depth, max_base_error[0], min_base_qual, depths, errors)
        reason = simplex_reason(F.col("cD"), F.col("cE"), min_reads[0], max_read_error[0])
    if min_methylation_depth is not None:
        rows = methylation_mask(rows.withColumnRenamed("newly", "before_"), min_methylation_depth).withColumn("newly", F.col("newly") + F.col("before_")).drop("before_")
    if regenerate is not None:
        rows = regenerate(rows)
    low = F.col("mean_") < min_mean_qual if min_mean_qual is not None else F.lit(False)
    tests = F.coalesce(reason, F.when(low, "low_mean_quality"), F.when(too_many_no_calls(F.col("seq"), max_no_calls), "too_many_no_calls"))
    if min_conversion is not None:
        share = conversion_fraction(F.col("ref"), F.col("cu"), F.col("ct"))
        tests = F.coalesce(tests, F.when(share < min_conversion, "low_conversion"))
    rows = rows.withColumn("reason", tests).drop("mean_")
    passes = F.col("reason").isNull()
    kept = whole_templates(rows, passes, name, F.col(is_primary) if is_primary else None) if by_template else rows.filter(passes)
    counts = rows.groupBy(F.coalesce("reason", F.lit("passed")).alias("outcome")).agg(F.count("*").alias("reads"), F.sum("newly").cast("long").alias("bases_masked"))
    return kept.drop("reason"), counts
