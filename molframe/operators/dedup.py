"""Duplicate marking with its metrics, ladder and library size."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.operators.numbering import running_offsets


def read_score(qual: Column, qc_fail: Column | None = None) -> Column:
    """Sum of qualities of 15 and more, 16383 at most; 16384 less for reads that fail QC."""
    total = F.least(F.aggregate(F.filter(qual, lambda q: q >= 15), F.lit(0), lambda s, q: s + q), F.lit(16383))
    return total - F.when(qc_fail, 16384).otherwise(0) if qc_fail is not None else total


def mark_duplicates(templates: DataFrame, family: list[str], score: str = "score", name: str = "qname") -> DataFrame:
    """templates with duplicate: all but the one of the highest score of each family, the first by name of equals."""
    first = Window.partitionBy(*family).orderBy(F.col(score).desc(), name)
    return templates.withColumn("duplicate", F.row_number().over(first) > 1)


def dedup_metrics(marked: DataFrame, by: str = "library") -> DataFrame:
    """Templates, duplicates, unique ones and the rate for each library, and for all."""
    rows = marked.cube(by).agg(F.count("*").alias("total_templates"), F.sum(F.col("duplicate").cast("long")).alias("duplicate_templates"), F.grouping_id().alias("g"))
    rows = rows.select(F.when(F.col("g") == 0, F.col(by)).otherwise("all").alias(by), "total_templates", "duplicate_templates", (F.col("total_templates") - F.col("duplicate_templates")).alias("unique_templates"))
    return rows.withColumn("duplicate_rate", F.col("duplicate_templates") / F.col("total_templates"))


def duplication_ladder(groups: DataFrame, order: list[str], interval: int, library: str = "library") -> DataFrame:
    """groups (library, order, templates, duplicates), a row for each position group, to the rows of each library at which its running templates pass a multiple of the interval, and its last.

    Running totals are over all groups in the order of library and position, by ranges; a library's own begin where it does. Only the rows of the ladder meet in a window."""
    run = running_offsets(groups.filter("templates > 0").select(library, *order, "templates", "duplicates"), [library, *order], ["templates", "duplicates"], ["templates_before", "duplicates_before"])
    whole = groups.groupBy(library).agg(F.sum("templates").alias("all_templates"))
    base = run.groupBy(library).agg(F.min("templates_before").alias("t0"), F.min("duplicates_before").alias("d0")).join(whole, library)
    run = run.join(base, library).select(library, "templates", (F.col("templates_before") - F.col("t0") + F.col("templates")).alias("templates_seen"), (F.col("duplicates_before") - F.col("d0") + F.col("duplicates")).alias("seen_duplicates"), "all_templates")
    crossed = F.expr(f"templates_seen div {interval} > (templates_seen - templates) div {interval}")
    rows = run.filter(crossed | (F.col("templates_seen") == F.col("all_templates")))
    before = Window.partitionBy(library).orderBy("templates_seen")
    rows = rows.withColumn("window_templates", F.col("templates_seen") - F.coalesce(F.lag("templates_seen").over(before), F.lit(0)))
    rows = rows.withColumn("window_duplicates", F.col("seen_duplicates") - F.coalesce(F.lag("seen_duplicates").over(before), F.lit(0)))
    return rows.select(library, "templates_seen", (F.col("seen_duplicates") / F.col("templates_seen")).alias("duplicate_fraction"), "window_templates", (F.col("window_duplicates") / F.col("window_templates")).alias("window_duplicate_fraction"))


def library_size(pairs: int, unique: int) -> int | None:
    """The Lander-Waterman estimate of distinct molecules: the root of c/x - 1 + exp(-n/x), by 40 bisections; none without duplicates."""
    if pairs <= 0 or unique <= 0 or unique >= pairs:
        return None
    f = lambda x: unique / x - 1 + math.exp(-pairs / x)
    low, high = 1.0, 100.0
    if f(low * unique) < 0:
        return None
    while f(high * unique) >= 0:
        high *= 10
    for _ in range(40):
        middle = (low + high) / 2
        at = f(middle * unique)
        if at == 0:
            break
        low, high = (middle, high) if at > 0 else (low, middle)
    return int(unique * ((low + high) / 2))


@F.pandas_udf(T.LongType())
def library_size_udf(pairs: pd.Series, unique: pd.Series) -> pd.Series:
    return pd.Series([library_size(int(n), int(c)) for n, c in zip(pairs, unique, strict=True)], dtype="Int64")
