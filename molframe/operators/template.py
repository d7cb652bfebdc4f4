"""Template filters with their reasons, correction of UMIs against a list, extraction, zipping and retagging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.bind import let
from molframe.functions.dna import called_bases, has_no_call, reverse_complement
from molframe.functions.structure import parse, pieces


def reject_reason(umi: Column, mapq: Column, mate_mapq: Column, min_mapq: int = 1, min_umi: int | None = None, unmapped: Column | None = None, not_passing: Column | None = None) -> Column:
    """The first failing test of a template, null if none: unmapped, non-PF, MAPQ, mate MAPQ, N in the UMI, short UMI, missing UMI."""
    tests = [("fully_unmapped", unmapped), ("non_pf", not_passing), ("low_mapq", mapq < min_mapq), ("low_mate_mapq", mate_mapq < min_mapq), ("umi_has_n", has_no_call(umi)), ("umi_too_short", called_bases(umi) < min_umi if min_umi else None), ("umi_missing", umi.isNull())]
    return F.coalesce(*[F.when(test, name) for name, test in tests if test is not None])


def mismatches(observed: Column, fixed: Column) -> Column:
    """Unlike characters; characters that only the longer has count too."""
    wide = F.greatest(F.length(observed), F.length(fixed)).cast("int")
    pairs = F.zip_with(F.split(F.rpad(observed, wide, "\x01"), ""), F.split(F.rpad(fixed, wide, "\x02"), ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)


def best_matches(segments: DataFrame, fixed: list[str], max_mismatches: int = 2, min_distance: int = 1) -> DataFrame:
    """(segment, matched, umi, mismatches, second) of each distinct segment: the nearest of the list, the first in order of ties, if near enough and far enough from the second."""
    fixed = sorted({u.strip().upper() for u in fixed})  # a small list given by the caller
    if len({len(u) for u in fixed}) > 1:
        raise ValueError("UMIs of the list differ in length")
    near = F.array_sort(F.transform(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(i).alias("i")) for i, u in enumerate(fixed)]), lambda f: F.struct(mismatches(F.col("segment"), f["u"]).alias("d"), f["i"].alias("i"), f["u"].alias("u"))))

    def answer(near: Column) -> Column:
        best, second = near[0], F.get(near, F.lit(1))
        distant = second.isNull() | (second["d"] - best["d"] >= min_distance)
        return F.struct(((best["d"] <= max_mismatches) & distant).alias("matched"), best["u"].alias("umi"), best["d"].cast("int").alias("mismatches"), second["d"].cast("int").alias("second"))

    # one row for each distinct segment, made before the answers' parts are taken out, so that they are found once
    return segments.select("segment").distinct().select("segment", F.inline(F.array(let(near, answer))))


def correct_umis(templates: DataFrame, fixed: list[str], max_mismatches: int = 2, min_distance: int = 1, umi: str = "umi", revcomp: bool = False) -> DataFrame:
    """templates with corrected (null where a segment fails), original (where it was changed by a mismatch) and total_mismatches. Only distinct segments are matched."""
    parts = F.split(F.upper(umi), "-")
    if revcomp:
        parts = F.reverse(F.transform(parts, reverse_complement))
    width = len(fixed[0].strip())
    distinct = templates.select(F.upper(umi).alias("observed")).distinct().withColumn("parts", F.split("observed", "-") if not revcomp else F.reverse(F.transform(F.split("observed", "-"), reverse_complement)))
    cut = distinct.select("observed", F.posexplode("parts").alias("place", "segment"))
    matched = cut.join(best_matches(cut, fixed, max_mismatches, min_distance), "segment")
    whole = matched.groupBy("observed").agg(
        F.min(F.col("matched") & (F.length("segment") == width)).alias("ok"), F.array_sort(F.collect_list(F.struct("place", "umi"))).alias("found"), F.sum("mismatches").cast("long").alias("total_mismatches")
    )
    whole = whole.select("observed", F.when(F.col("ok"), F.array_join(F.transform("found", lambda x: x["umi"]), "-")).alias("corrected"), "total_mismatches")
    return templates.join(whole, F.upper(umi) == F.col("observed"), "left").withColumn("original", F.when(F.col("corrected").isNotNull() & (F.col("total_mismatches") > 0), F.col(umi))).drop("observed")


def correction_metrics(segments: DataFrame, matches: DataFrame, fixed: list[str]) -> DataFrame:
    """A row for each UMI of the list and one, of N, for what matched none: counts by mismatches, fraction, and representation against the mean of the list."""
    spark = segments.sparkSession
    counts = segments.groupBy("segment").agg(F.count("*").alias("c")).join(matches, "segment")
    none = "N" * len(fixed[0])
    named = counts.withColumn("to", F.when(F.col("matched"), F.col("umi")).otherwise(none)).groupBy(F.col("to").alias("umi")).agg(
        *[F.sum(F.when(test & F.col("matched") if name != "total_matches" else test, F.col("c")).otherwise(0)).alias(name) for name, test in (("total_matches", F.lit(True)), ("perfect_matches", F.col("mismatches") == 0), ("one_mismatch_matches", F.col("mismatches") == 1), ("two_mismatch_matches", F.col("mismatches") == 2), ("other_matches", F.col("mismatches") > 2))]
    )
    every = spark.createDataFrame([(u,) for u in sorted(set(fixed) | {none})], "umi string").join(named, "umi", "left").fillna(0)
    all_, list_ = Window.partitionBy(), F.sum(F.when(F.col("umi") != none, F.col("total_matches"))).over(Window.partitionBy())
    return every.withColumn("fraction_of_matches", F.try_divide("total_matches", F.sum("total_matches").over(all_))).withColumn("representation", F.try_divide(F.col("total_matches"), list_ / F.lit(len(set(fixed)))))


def extract(reads: DataFrame, structures: dict[str, str], name_umi: Column | None = None, qualities: dict[str, str] | None = None, annotate: str | None = None, read_group: str | None = None) -> DataFrame:
    """reads (qname, <column>, ...) cut by the read structure of each column: umi, cell, sample barcodes joined by - and template_<i> sequences; an empty template is N.

    With qualities (the column of quality text of each column) also umi_qual, cell_qual, sample_qual, joined by spaces, and template_<i>_qual; an empty template's is that of quality 2. A UMI of the name stands first and has no qualities. annotate names a
    column whose text gets +umi behind it; read_group is a constant rg."""
    by: dict[str, list[Column]] = {k: [] for k in "MCBT"}
    of: dict[str, list[Column]] = {k: [] for k in "MCBT"}
    for column, text in structures.items():
        segments = parse(text)
        for kind in by:
            by[kind] += pieces(F.col(column), segments, kind)
            if qualities:
                of[kind] += pieces(F.col(qualities[column]), segments, kind)
    umi = [*([name_umi] if name_umi is not None else []), *by["M"]]
    named = {"umi": umi, "cell": by["C"], "sample": by["B"]}
    out = reads.select("*", *[F.concat_ws("-", *parts).alias(name) for name, parts in named.items() if parts], *[F.concat_ws(" ", *of[k]).alias(f"{n}_qual") for n, k in (("umi", "M"), ("cell", "C"), ("sample", "B")) if of[k]])
    out = out.select("*", *[F.when(F.length(t) == 0, "N").otherwise(t).alias(f"template_{i + 1}") for i, t in enumerate(by["T"])], *[F.when(F.length(t) == 0, "#").otherwise(t).alias(f"template_{i + 1}_qual") for i, t in enumerate(of["T"])])
    if annotate is not None:
        out = out.withColumn(annotate, F.when(F.length("umi") > 0, F.concat(F.col(annotate), F.lit("+"), F.col("umi"))).otherwise(F.col(annotate)))
    return out.withColumn("rg", F.lit(read_group)) if read_group is not None else out


def template_reason(umi: Column, min_mapq: int = 1, min_umi: int | None = None, malformed: Column | None = None, allow_unmapped: bool = False, no_umi: bool = False, include_non_pf: bool = False) -> Column:
    """The first failing test of a template of two reads (present<i>, unmapped<i>, qc_fail<i>, mapq<i>, mate_mapq<i>; an absent read has present<i> false): malformed, no primary read, fully unmapped; then of read 1 and read 2 in turn non-PF and MAPQ; then of
    each in turn the mate's MAPQ and the UMI. Mapping qualities count for mapped reads and mates."""
    here = lambda i: F.coalesce(F.col(f"present{i}"), F.lit(False))
    mapped = lambda i: here(i) & ~F.coalesce(F.col(f"unmapped{i}"), F.lit(False))
    tests = [("malformed_record", malformed), ("no_primary_reads", ~here(1) & ~here(2)), ("fully_unmapped", None if allow_unmapped else ~mapped(1) & ~mapped(2))]
    for i in (1, 2):
        tests += [("non_pf", None if include_non_pf else here(i) & F.coalesce(F.col(f"qc_fail{i}"), F.lit(False))), ("low_mapq", mapped(i) & (F.col(f"mapq{i}") < min_mapq))]
    for i in (1, 2):
        tests.append(("low_mate_mapq", here(i) & ~F.coalesce(F.col(f"unmapped{3 - i}"), F.lit(False)) & (F.col(f"mate_mapq{i}") < min_mapq)))
        if not no_umi:
            tests += [("umi_has_n", here(i) & has_no_call(umi)), ("umi_too_short", here(i) & (called_bases(umi) < min_umi) if min_umi else None), ("umi_missing", here(i) & umi.isNull())]
    return F.coalesce(*[F.when(test, name) for name, test in tests if test is not None])


def zip_many(inputs: list[DataFrame], ordinal: str = "ord", name: str = "qname") -> DataFrame:
    """(ordinal, name, r1, r2, ...: the records of each input) side by side; an error if counts or names differ."""
    keyed = [df.select(F.col(ordinal).alias("o_"), F.struct("*").alias(f"r{i + 1}")) for i, df in enumerate(inputs)]
    both = reduce(lambda a, b: a.join(b, "o_", "full_outer"), keyed)
    names = [F.col(f"r{i + 1}.{name}") for i in range(len(inputs))]
    same = reduce(lambda a, b: a & b, [n.isNotNull() & n.eqNullSafe(names[0]) for n in names])
    return both.select(F.when(same, F.col("o_")).otherwise(F.raise_error(F.lit("inputs differ in reads"))).alias(ordinal), names[0].alias(name), *[f"r{i + 1}" for i in range(len(inputs))])


def zip_names(left: DataFrame, right: DataFrame, ordinal: str = "ord", name: str = "qname") -> DataFrame:
    """Reads of two files side by side; an error if counts or names differ."""
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{ordinal}") == F.col(f"r.{ordinal}"), "full_outer")
    same = F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) & F.col(f"l.{name}").isNotNull()
    return both.select(F.when(same, F.col(f"l.{ordinal}")).otherwise(F.raise_error(F.lit("inputs differ in reads"))).alias(ordinal), F.col(f"l.{name}").alias(name), F.struct("l.*").alias("r1"), F.struct("r.*").alias("r2"))


def zipper(unmapped: DataFrame, mapped: DataFrame, tags: list[str], keys: tuple[str, ...] = ("qname", "segment"), reverse: tuple[str, ...] = (), revcomp: tuple[str, ...] = (), exclude_missing: bool = False, strand: str = "reverse") -> DataFrame:
    """Mapped records with the unmapped ones' tags, those of `reverse` and `revcomp` turned where the record is on the reverse strand. Unmapped records without a mapped one are kept as unmapped unless excluded; a mapped record without an
    unmapped one is an error."""

    def tag(t: str) -> Column:
        c = F.col(f"u.{t}")
        turned = F.reverse(c) if t in reverse else reverse_complement(c) if t in revcomp else c
        return F.when(F.coalesce(F.col(f"m.{strand}"), F.lit(False)), turned).otherwise(c).alias(t)

    u, m = unmapped.alias("u"), mapped.alias("m")
    on = [F.col(f"u.{k}") == F.col(f"m.{k}") for k in keys]
    joined = u.join(m, on, "right" if exclude_missing else "full_outer")
    stray = F.raise_error(F.concat(F.lit("mapped without an unmapped record: "), F.col(f"m.{keys[0]}").cast("string")))
    first = F.when(F.col(f"u.{keys[0]}").isNull(), stray).otherwise(F.col(f"u.{keys[0]}")).alias(keys[0])
    own = [c for c in mapped.columns if c not in keys and c not in tags]
    return joined.select(first, *[F.col(f"u.{k}") for k in keys[1:]], *[F.col(f"m.{c}") for c in own], *[tag(t) for t in tags], F.col(f"m.{keys[0]}").isNull().alias("missing"))


def leftover(unmapped: DataFrame, mapped: DataFrame, keys: tuple[str, ...] = ("qname", "segment")) -> DataFrame:
    """Mapped records that no unmapped one has; any is an error in a zip."""
    return mapped.join(unmapped, list(keys), "left_anti")


def retag(records: DataFrame, ops: list[str], tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """Applies `SRC::copy::DST`, `SRC::move::DST` and `SRC::delete` from left to right to a map of tags; and a row of counters for each."""
    cur, counters = F.col(tags), []
    df = records
    for i, op in enumerate(ops):
        parts = op.split("::")
        if len(parts) not in (2, 3) or (parts[1] == "delete") != (len(parts) == 2) or parts[1] not in ("copy", "move", "delete"):
            raise ValueError(f"not a tag operation: {op!r}")
        src, kind, dst = parts[0], parts[1], parts[2] if len(parts) == 3 else None
        has = F.map_contains_key(cur, src)
        without = _without(cur, {"move": [src, dst], "copy": [dst], "delete": [src]}[kind])
        new = without if kind == "delete" else F.map_concat(without, F.create_map(F.lit(dst), F.element_at(cur, src)))
        df = df.withColumn(f"hit_{i}", has).withColumn(f"over_{i}", has & F.map_contains_key(cur, dst) if dst else F.lit(False)).withColumn(tags, F.when(has, new).otherwise(cur))
        counters.append(F.struct(F.lit(op).alias("operation"), F.sum(F.col(f"hit_{i}").cast("long")).alias("records_applied"), F.sum(F.col(f"over_{i}").cast("long")).alias("dst_overwritten"), F.sum((~F.col(f"hit_{i}")).cast("long")).alias("src_missing")))
    rows = df.agg(F.array(*counters).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return df.drop(*[f"{x}_{i}" for i in range(len(ops)) for x in ("hit", "over")]), rows


def _without(tags: Column, drop: list) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*drop))


def downsample(reads: DataFrame, family: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Whole families, each kept if a hash of its key and the seed falls below the fraction."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    return reads.filter(_sampled(family, fraction, seed))


def _sampled(family: list[str], fraction: float, seed: int) -> Column:
    part = F.conv(F.substring(F.md5(F.concat_ws(":", *family, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return part < F.lit(int(fraction * (1 << 32)))


def downsample_with_rejects(reads: DataFrame, family: list[str], fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads kept, reads rejected, (kept boolean, family_size, count): the sizes of both kinds of families)."""
    kept = downsample(reads, family, fraction, seed)
    sizes = reads.groupBy(*family).agg(F.count("*").alias("family_size")).withColumn("kept", _sampled(family, fraction, seed))
    return kept, reads.filter(~_sampled(family, fraction, seed)), sizes.groupBy("kept", "family_size").agg(F.count("*").alias("count"))
