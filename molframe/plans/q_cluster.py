"""Queries on UMI clustering, each with a recursive DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe.operators import cluster as c
from molframe.plans.readview import DUCK, reads
from molframe.session import written

QUERIES: dict = {}
SQL: dict = {}
KEYS = ["tid", "pos"]

_NODES = """, nodes AS (SELECT *, row_number() OVER (PARTITION BY tid, pos ORDER BY n DESC, umi) AS r FROM (SELECT tid, pos, {umi} AS umi, count(*) AS n FROM reads GROUP BY ALL))"""
_EDGES = ", edges AS (SELECT a.tid, a.pos, a.r AS a, b.r AS b FROM nodes a JOIN nodes b ON a.tid = b.tid AND a.pos = b.pos AND a.r <> b.r AND {near} <= 1 {counts})"
_LABELS = """, walk AS (SELECT tid, pos, r AS label, r FROM nodes UNION SELECT w.tid, w.pos, w.label, e.b FROM walk w JOIN edges e ON w.tid = e.tid AND w.pos = e.pos AND w.r = e.a),
   labels AS (SELECT tid, pos, r, min(label) AS label FROM walk GROUP BY tid, pos, r)"""
_COUNTS = "AND b.n <= a.n // 2 + 1"


def _rows(spark, d, strategy, umi="rx", **more):
    return c.cluster(reads(spark, d), KEYS, umi=umi, strategy=strategy, **more)


def _sql(umi: str, near: str, counts: str, tail: str) -> str:
    return DUCK + _NODES.format(umi=umi) + _EDGES.format(near=near, counts=counts) + _LABELS + tail


_ROOTS = " SELECT n.tid, n.pos, n.umi, n.n, root.umi AS root FROM nodes n JOIN labels l ON n.tid = l.tid AND n.pos = l.pos AND n.r = l.r JOIN nodes root ON root.tid = n.tid AND root.pos = n.pos AND root.r = l.label"


def _roots(strategy, **more):
    return lambda spark, d: _rows(spark, d, strategy, **more).select("tid", "pos", "umi", "n", "root")


QUERIES["group_adjacency"] = _roots("adjacency")
SQL["group_adjacency"] = _sql("rx", "hamming(a.umi, b.umi)", _COUNTS, _ROOTS)
QUERIES["group_edit"] = _roots("edit")
SQL["group_edit"] = _sql("rx", "hamming(a.umi, b.umi)", "", _ROOTS)

#: The same by the distributed fixpoint, which larger groups take: of the groups of a few positions, whose edges the check can afford.
QUERIES["group_adjacency_fixpoint"] = _roots("adjacency", local=0)
SQL["group_adjacency_fixpoint"] = SQL["group_adjacency"]

_FLIP = "concat(split_part({0}, '-', 2), '-', split_part({0}, '-', 1))"
_PAIRED = f"least(hamming(a.umi, b.umi), hamming(a.umi, {_FLIP.format('b.umi')}))"
_CANON = f"least(dual, {_FLIP.format('dual')})"


def _group_paired(spark, d):
    from molframe.functions.dna import canonical

    # distinct UMIs as they were read, with counts, are made once and serve both steps
    kinds = written(reads(spark, d).groupBy(*KEYS, "dual").agg(F.count("*").alias("reads")).withColumn("umi", canonical(F.col("dual"))), "duals")
    roots = c.cluster(kinds, KEYS, strategy="paired", count="reads").select(*KEYS, "umi", "root")
    strands = kinds.join(roots, [*KEYS, "umi"]).withColumn("strand", c.paired_strand(F.col("dual"), F.col("root")))
    return strands.groupBy(*KEYS, "root", "strand").agg(F.sum("reads").alias("reads"), F.count("*").alias("umis"))


QUERIES["group_paired"] = _group_paired
SQL["group_paired"] = _sql(
    _CANON, _PAIRED, _COUNTS,
    f""", roots AS ({_ROOTS}), s AS (SELECT r.tid, r.pos, x.root, r.dual, CASE WHEN hamming(x.root, r.dual) < hamming(x.root, {_FLIP.format("r.dual")}) THEN 'A' ELSE 'B' END AS strand
     FROM reads r JOIN roots x ON x.tid = r.tid AND x.pos = r.pos AND x.umi = {_CANON.replace("dual", "r.dual")})
   SELECT tid, pos, root, strand, count(*) AS reads, count(DISTINCT dual) AS umis FROM s GROUP BY ALL""",
)


def _identity(spark, d):
    return c.number_molecules(_rows(spark, d, "identity"), KEYS, "identity").select(*KEYS, "umi", "n", "mi")


QUERIES["group_identity"] = _identity
SQL["group_identity"] = DUCK + " SELECT tid, pos, rx AS umi, count(*) AS n, row_number() OVER (ORDER BY tid, pos, rx) - 1 AS mi FROM reads GROUP BY tid, pos, rx"


def _numbered(strategy):
    return lambda spark, d: c.number_molecules(_rows(spark, d, strategy), KEYS, strategy).groupBy("mi", *KEYS).agg(F.sum("n").alias("reads"), F.min("umi").alias("first_umi"))


_MOLECULES = """, m AS (SELECT n.tid, n.pos, l.label, min(n.umi) AS first_umi, CAST(sum(n.n) AS BIGINT) AS reads FROM nodes n JOIN labels l ON n.tid = l.tid AND n.pos = l.pos AND n.r = l.r GROUP BY ALL)
   SELECT row_number() OVER (ORDER BY tid, pos, {order}) - 1 AS mi, tid, pos, reads, first_umi FROM m"""
QUERIES["molecules_adjacency"] = _numbered("adjacency")
SQL["molecules_adjacency"] = _sql("rx", "hamming(a.umi, b.umi)", _COUNTS, _MOLECULES.format(order="label"))
QUERIES["molecules_edit"] = _numbered("edit")
SQL["molecules_edit"] = _sql("rx", "hamming(a.umi, b.umi)", "", _MOLECULES.format(order="first_umi"))
