"""Queries on streams in batch form, intervals of time, simulated reads and text tables, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe.operators import clip
from molframe.operators.dedup import mark_duplicates
from molframe.plans.readview import reads
from molframe.session import table
from molframe.sources.simulate import grouped_reads
from molframe.streaming.rates import closed_families, duplicate_rates

QUERIES: dict = {}
SQL: dict = {}


def _events(spark, d):
    return duplicate_rates(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


QUERIES["hourly_duplicate_rate"] = _events
SQL["hourly_duplicate_rate"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS events, count(DISTINCT (user_id, event_type)) AS distinct_keys,
   1 - count(DISTINCT (user_id, event_type)) / count(*) AS duplicate_rate FROM events GROUP BY 1"""


def _sessions(spark, d):
    return closed_families(table(spark, d, "events"), ("user_id",), gap="30 minutes").groupBy("user_id", "size").agg(F.count("*").alias("families"))


QUERIES["closed_families"] = _sessions
SQL["closed_families"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
   s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e), c AS (SELECT user_id, g, count(*) AS size FROM s GROUP BY ALL)
   SELECT user_id, size, count(*) AS families FROM c GROUP BY ALL"""


def _event_dedup(spark, d):
    rows = table(spark, d, "events")
    return mark_duplicates(rows, ["user_id", "event_type"], score="value", name="event_id").filter("NOT duplicate").select("event_id", "user_id", "event_type")


QUERIES["best_event_of_family"] = _event_dedup
SQL["best_event_of_family"] = """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1"""


def _simulated(spark, d):
    """As many molecules as there are suppliers."""
    return grouped_reads(spark, table(spark, d, "supplier").count()).groupBy("mi").agg(F.count("*").alias("reads"), F.count_if(F.col("rx") != F.col("true_umi")).alias("wrong_umis"))


QUERIES["simulate_grouped_reads"] = _simulated


def _clipped(spark, d):
    ops = lambda n: F.array(F.struct(F.lit("S").alias("op"), F.lit(1).alias("len")), F.struct(F.lit("M").alias("op"), F.lit(n).alias("len")))
    rows = reads(spark, d)
    pairs = rows.select("qname", *[x for i, p in ((1, F.col("pos") + 3), (2, F.col("pos") + F.col("line"))) for x in (p.alias(f"pos{i}"), ops(5).alias(f"cigar{i}"), F.col("seq").alias(f"seq{i}"), F.col("qual").alias(f"qual{i}"), F.lit(i == 2).alias(f"reverse{i}"))])
    return clip.clipping_metrics(clip.clip_pairs(pairs, overlap=True, fixed=(1, 0, 0, 0)))


QUERIES["clip_pairs"] = _clipped
