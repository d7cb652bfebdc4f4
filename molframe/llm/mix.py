"""Mixing sources to target weights.

Token sums by source and hash bucket give nested budget thresholds: at each level only the bucket in which a
source's budget ends is cut finer, and rows are then kept by comparing a hash, without any sort of rows.

Defined results: a null text has size 0; sources are ordered by code point, null last, each null counting as one
source; a source of size 0 has target 0; rows with equal id and text have equal hashes and are taken alike;
an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.session import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits that a level adds; all levels together are the resolution of the threshold.
LEVEL_BITS, LEVELS = 16, 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with target. A row per source: what exceeds `most` sizes is shared out again by weight until none is above."""
    everything, ordered = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("level", F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", F.array(*[F.lit(w) for w in weights])[(F.row_number().over(ordered) - 1) % len(weights)].cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("rate", F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", "rate"))).over(everything)["rate"])
        .select("source", "source_size", F.coalesce(F.least("cap", F.col("rate") * F.col("weight")), F.col("cap")).alias("target"))
    )


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, the columns of keep): how often the mix takes each row."""
    own_hash = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    measured = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(own_hash, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long").alias("hash"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    rows = written(measured.drop(*[f"keep_{i}" for i in range(len(keep))]), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    edge = source_targets(sizes, weights, share, most).select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
    )
    edge = edge.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    for level in range(1, LEVELS + 1):
        edge = written(_refined(rows, edge, LEVEL_BITS * (LEVELS - level)), f"mix-level{level}")
    copies = (F.col("epochs") + F.when(F.col("hash") <= F.col("last"), 1).otherwise(0)).cast("long")
    # columns to keep come from the rows themselves, whose sizes and hashes are computed once more; else the narrow table is read
    return (measured if keep else rows).join(edge.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source"))).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    )


def _refined(rows: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    """One level: the histogram inside each source's boundary bucket, then the bucket in it where the budget ends."""
    buckets = (
        rows.join(edge.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        .groupBy("source", F.shiftright("hash", shift).alias("bucket"))
        .agg(F.sum("size").alias("n"))
    )
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        buckets.withColumnRenamed("source", "s")
        .join(edge.select(F.col("source").alias("t"), F.col("below").alias("was"), F.col("rest").alias("until")), F.col("s").eqNullSafe(F.col("t")))
        .withColumn("end", F.col("was") + F.sum("n").over(upto))
        .groupBy("s")
        .agg(
            F.min(F.when(F.col("end") > F.col("until"), F.struct("bucket", (F.col("end") - F.col("n")).alias("below")))).alias("at"),
            F.max(F.when(F.col("end") - F.col("n") + F.col("n") / 2.0 <= F.col("until"), F.col("bucket"))).alias("taken_last"),
        )
    )
    out = edge.drop("last").join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select(
        "source", "source_size", "target", "epochs", "rest",
        F.coalesce(F.col("at.bucket"), F.lit(-1)).cast("long").alias("prefix"),
        F.coalesce(F.col("at.below"), F.col("below")).cast("long").alias("below"),
        # below the boundary bucket's first hash all is taken; at the last level a bucket is one hash
        (F.coalesce(F.col("taken_last"), F.shiftleft("prefix", LEVEL_BITS) - 1) if shift == 0 else F.lit(-1)).cast("long").alias("last"),
    )


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS level, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
f AS (SELECT *, sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS filled,
             sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM l),
r AS (SELECT *, (budget - filled) / open AS rate FROM f),
t AS (SELECT *, least(cap, (SELECT arg_min(rate, level) FROM r WHERE rate <= level) * weight) AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
u AS (SELECT source, hash, CAST(sum(size) AS BIGINT) AS n FROM rows GROUP BY source, hash),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS before FROM u),
k AS (SELECT c.source, c.hash, c.before + c.n / 2.0::DOUBLE <= e.target - e.epochs * e.source_size AS once_more
      FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source)
SELECT rows.doc_id, CAST(rows.size AS BIGINT) AS size, e.source_size, e.target,
       CAST(rows.size * (e.epochs + CASE WHEN k.once_more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows JOIN e ON rows.source IS NOT DISTINCT FROM e.source
JOIN k ON rows.source IS NOT DISTINCT FROM k.source AND rows.hash = k.hash
"""
