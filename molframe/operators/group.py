"""The whole steps of grouping and of duplicate marking: filter, orient, assign, number, emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.dna import flipped
from molframe.operators.cluster import cluster, number_molecules
from molframe.operators.dedup import mark_duplicates
from molframe.operators.metrics import grouping_summary, size_distribution
from molframe.session import written

STRATEGIES = ("identity", "edit", "adjacency", "paired")


def molecule_umi(umi: Column, strategy: str, r1_earlier: Column, min_umi_length: int | None = None, no_umi: bool = False) -> Column:
    """The UMI by which a template is assigned: in upper case, cut to min_umi_length; of dual UMIs (paired) the half of the read that lies first on the genome first, so that both strands of a molecule agree. An error for a
    missing UMI, one shorter than min_umi_length, or one that is not of two halves where these are asked for."""
    if no_umi:
        return F.lit("")
    text = F.when(umi.isNull(), F.raise_error(F.lit("missing UMI"))).otherwise(F.upper(umi))
    if strategy == "paired":
        halves = F.when(F.size(F.split(text, "-")) != 2, F.raise_error(F.concat(F.lit("not a UMI of two halves: "), text))).otherwise(text)
        return F.when(F.coalesce(r1_earlier, F.lit(True)), halves).otherwise(flipped(halves))
    if min_umi_length is not None:
        text = F.when(F.length(text) < min_umi_length, F.raise_error(F.lit("UMI shorter than expected"))).otherwise(F.substring(text, 1, min_umi_length))
    return text


def group(
    templates: DataFrame, keys: list[str], strategy: str = "adjacency", edits: int = 1, umi: str = "umi", reason: Column | None = None, r1_forward: str = "r1_forward", r2_forward: str = "r2_forward", r1_earlier: str = "r1_earlier",
    min_umi_length: int | None = None, no_umi: bool = False, split_strands: bool = True,
) -> DataFrame:
    """templates whose reason is null, with molecule (its number over all groups, in the order of keys, then orientation) and mi (its text; of paired /A for templates whose first read lies first, /B for the others).

    Templates of a position group are parted by the strands of their two reads (null: forward), but for paired, where the order of the reads takes the strand's place. keys must not be null."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    if strategy == "paired" and min_umi_length is not None:
        raise ValueError("UMIs of two halves can't be cut")
    # written once, as they are needed twice: to be counted and to get their molecules; and what derives and rejects them is not repeated in every filter that Catalyst moves down
    rows = written(templates.withColumn("reason_", reason if reason is not None else F.lit(None).cast("string")), "templates")
    kept = rows.filter("reason_ IS NULL").drop("reason_")
    earlier = F.coalesce(F.col(r1_earlier), F.lit(True)) if r1_earlier in templates.columns else F.lit(True)
    kept = kept.withColumn("umi_", molecule_umi(F.lit(None) if no_umi else F.col(umi), strategy, earlier, min_umi_length, no_umi))
    parted = [] if strategy == "paired" or not split_strands else ["r1_", "r2_"]
    for name, column in zip(parted, (r1_forward, r2_forward), strict=False):
        kept = kept.withColumn(name, F.coalesce(F.col(column), F.lit(True)))
    by = [*keys, *parted]
    how = "adjacency" if strategy == "paired" else "identity" if no_umi else strategy
    numbered = number_molecules(cluster(kept, by, "umi_", how, edits), by, how).select(*by, F.col("umi").alias("umi_"), F.col("mi").alias("molecule"))
    mi = F.col("molecule").cast("string")
    out = kept.join(numbered, [*by, "umi_"]).withColumn("mi", F.concat(mi, F.when(earlier, "/A").otherwise("/B")) if strategy == "paired" else mi)
    return out.select(*templates.columns, "molecule", "mi")


def emitted(grouped: DataFrame, name: str = "qname") -> DataFrame:
    """Templates in the order in which they are written: by molecule, strand and name."""
    return grouped.orderBy("molecule", "mi", name)


def group_metrics(templates: DataFrame, grouped: DataFrame, keys: list[str], reason: Column) -> dict[str, DataFrame]:
    """filter: templates accepted and rejected by reason; family_sizes and position_group_sizes (families of a position): distributions; summary of the families."""
    families = grouped.groupBy(*keys, "mi").agg(F.count("*").alias("size"))
    positions = families.groupBy(*keys).agg(F.count("*").alias("size"))
    counted = templates.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("templates"))
    return {"filter": counted, "family_sizes": size_distribution(families), "position_group_sizes": size_distribution(positions, named="position_group_size"), "summary": grouping_summary(families)}


def deduplicate(templates: DataFrame, keys: list[str], score: str = "score", name: str = "qname", reason: Column | None = None, unmapped: Column | None = None, remove: bool = False, no_umi: bool = False, **options) -> DataFrame:
    """Templates grouped and marked (duplicate: all of a family but the one of the highest score, the first by name of equals), or without the duplicates. Templates for which `unmapped` holds pass without filter or molecule, as unique. Without UMIs the
    strands of the reads don't part a group."""
    aside = templates.filter(unmapped) if unmapped is not None else None
    rows = templates.filter(~F.coalesce(unmapped, F.lit(False))) if unmapped is not None else templates
    marked = mark_duplicates(group(rows, keys, reason=reason, no_umi=no_umi, split_strands=not no_umi, **options), ["mi"], score, name)
    if aside is not None:
        marked = marked.unionByName(aside.withColumn("molecule", F.lit(None).cast("long")).withColumn("mi", F.lit(None).cast("string")).withColumn("duplicate", F.lit(False)))
    return marked.filter(~F.col("duplicate")) if remove else marked
