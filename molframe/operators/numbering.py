"""Running totals over an ordered table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molframe.session import written


def running_offsets(groups: DataFrame, order: list[str], size: str | list[str], out: str | list[str] = "offset") -> DataFrame:
    """groups with the sum of each `size` over all groups before, in the order of the unique key `order`.

    Groups are dealt to ranges of the key; the ranges' totals, a row for each range, are summed up alone, the rest inside each range. The number of ranges is that of shuffle partitions, which adaptive execution lowers for small tables."""
    sizes, names = ([size], [out]) if isinstance(size, str) else (size, out)
    dealt = written(groups.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(*[F.sum(s).alias(f"total_{i}") for i, s in enumerate(sizes)])
    totals = totals.select("range_", *[F.coalesce(F.sum(f"total_{i}").over(before), F.lit(0)).alias(f"base_{i}") for i in range(len(sizes))])
    inner = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(F.broadcast(totals), "range_")  # a row for each range
    return rows.select(*groups.columns, *[(F.col(f"base_{i}") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(n) for i, (s, n) in enumerate(zip(sizes, names, strict=True))])


def numbered(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of the unique key `order`. As running_offsets of ones, but rows move once: a sorted range counts its own."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range_": F.spark_partition_id(), "nth_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = written(dealt, "ranges")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(F.count("*").alias("total_")).select("range_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    return dealt.join(F.broadcast(totals), "range_").select(*rows.columns, (F.col("base_") + F.col("nth_")).alias(out))  # a row for each range
