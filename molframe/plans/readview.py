"""Reads derived from the test tables, in Spark SQL and in DuckDB SQL.

The tables have no sequencing reads; each row of lineitem becomes a read whose fields are exact integer functions of its columns, so that both engines derive the same reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from molframe.session import table

LENGTH = 6


def _base(p: int, wrong: str) -> str:
    return f"substr('ACGTACGT', CAST(((l_partkey >> {p}) & 3) AS INT) + CASE WHEN {wrong} THEN 1 ELSE 0 END + 1, 1)"


_UMI = "concat(" + ", ".join(f"substr('ACGT', CAST(((l_partkey >> {s}) & 3) AS INT) + 1, 1)" for s in (6, 4, 2, 0)) + ")"
_HALVES = [f"concat(substr('ACGT', CAST(((l_partkey >> {a}) & 3) AS INT) + 1, 1), substr('ACGT', CAST(((l_partkey >> {b}) & 3) AS INT) + 1, 1))" for a, b in ((6, 4), (2, 0))]
_SEQ = "concat(" + ", ".join(_base(p, f"(l_orderkey + {3 * p}) % 11 = 0") for p in range(LENGTH)) + ")"


def reads_sql(duck: bool) -> str:
    day = "strftime(l_shipdate, '%Y%m%d')" if duck else "date_format(l_shipdate, 'yyyyMMdd')"
    array = (lambda x: f"[{x}]") if duck else (lambda x: f"array({x})")
    quals = array(", ".join(f"CAST(10 + 2 * CAST(round(l_discount * 100) AS INT) + {p} AS INT)" for p in range(LENGTH)))
    return f"""
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), {day}) AS qname,
       CAST(l_suppkey % 5 AS INT) AS tid, CAST(l_suppkey AS BIGINT) AS pos, CAST(l_suppkey + 40 + l_linenumber AS BIGINT) AS mate_pos,
       l_linestatus = 'F' AS reverse, l_returnflag = 'N' AS mate_reverse, CAST(l_quantity AS INT) AS mapq, CAST(50 - l_quantity AS INT) AS mate_mapq,
       CAST(l_linenumber AS INT) AS line, CAST(l_orderkey AS BIGINT) AS ord, l_returnflag AS rg,
       {_UMI} AS rx, concat({_HALVES[0]}, '-', {_HALVES[1]}) AS dual,
       concat('lib', CAST(year(l_shipdate) % 3 AS INT)) AS library, CAST(round(l_extendedprice * 100) AS BIGINT) AS score,
       CASE WHEN l_linenumber = 7 THEN concat(substr({_UMI}, 1, 3), 'N') WHEN l_linenumber = 6 THEN NULL ELSE {_UMI} END AS raw_umi,
       {_SEQ} AS seq, {quals} AS qual
FROM lineitem"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(reads_sql(False).replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


DUCK = f"WITH RECURSIVE reads AS ({reads_sql(True)})"
