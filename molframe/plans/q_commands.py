"""Whole commands over the test tables: grouping, duplicate marking, filtering and metrics, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe.operators import consensus, filters, group, metrics, template
from molframe.plans.readview import DUCK, reads

QUERIES: dict = {}
SQL: dict = {}
KEYS = ["tid", "pos"]


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = DUCK + sql
        return f

    return keep


def templates(spark, d):
    return reads(spark, d).withColumns({"r1_forward": ~F.col("reverse"), "r2_forward": ~F.col("mate_reverse"), "r1_earlier": F.col("line") % 2 == 0})


def _narrow(spark, d):
    """Templates without the columns that grouping doesn't need."""
    return templates(spark, d).select("qname", *KEYS, "r1_forward", "r2_forward", "r1_earlier", "rx", "raw_umi", "dual", "mapq", "mate_mapq")


_T = ", t AS (SELECT *, NOT reverse AS r1, NOT mate_reverse AS r2, line % 2 = 0 AS earlier FROM reads)"
_PART = "tid, pos, r1, r2"


def _clusters(source: str, umi: str, part: str, near: str = "hamming(a.umi, b.umi) <= 1") -> str:
    """CTEs that end in mol: (part, umi, molecule) by adjacency; UMIs with N come last, each for itself."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in part.split(", "))
    return f""", nodes AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY valid DESC, CASE WHEN valid THEN n END DESC, umi) AS r FROM (SELECT {part}, {umi} AS umi, NOT contains({umi}, 'N') AS valid, count(*) AS n FROM {source} GROUP BY ALL)),
   edges AS (SELECT {", ".join(f"a.{k}" for k in part.split(", "))}, a.r AS a, b.r AS b FROM nodes a JOIN nodes b ON {same("a", "b")} AND a.r <> b.r AND a.valid AND b.valid AND {near} AND b.n <= a.n // 2 + 1),
   walk AS (SELECT {part}, r AS label, r FROM nodes UNION SELECT {", ".join(f"w.{k}" for k in part.split(", "))}, w.label, e.b FROM walk w JOIN edges e ON {same("w", "e")} AND w.r = e.a),
   labels AS (SELECT {part}, r, min(label) AS label FROM walk GROUP BY ALL),
   mol AS (SELECT {", ".join(f"n.{k}" for k in part.split(", "))}, n.umi, dense_rank() OVER (ORDER BY {", ".join(f"n.{k}" for k in part.split(", "))}, l.label) - 1 AS molecule FROM nodes n JOIN labels l ON {same("n", "l")} AND n.r = l.r)"""


def _reason():
    """Rejects low mapping quality and missing UMIs; those with N stay, to be molecules for themselves."""
    low = template.reject_reason(F.col("raw_umi"), F.col("mapq"), F.col("mate_mapq"), min_mapq=2)
    return F.when(low != "umi_has_n", low)


_KEPT = _T + ", k AS (SELECT * FROM t WHERE mapq >= 2 AND mate_mapq >= 2 AND raw_umi IS NOT NULL)"


@query("group_command", _KEPT + _clusters("k", "raw_umi", _PART) + """ SELECT k.qname, CAST(m.molecule AS BIGINT) AS molecule, CAST(m.molecule AS VARCHAR) AS mi FROM k JOIN mol m ON k.tid = m.tid AND k.pos = m.pos AND k.r1 = m.r1 AND k.r2 = m.r2 AND k.raw_umi = m.umi""")
def _(spark, d):
    return group.group(_narrow(spark, d), KEYS, "adjacency", 1, "raw_umi", _reason()).select("qname", "molecule", "mi")


_FLIP = "concat(split_part(dual, '-', 2), '-', split_part(dual, '-', 1))"
_ORDERED = _T + f", k AS (SELECT *, CASE WHEN earlier THEN dual ELSE {_FLIP} END AS ordered FROM t)"


@query("group_command_paired", _ORDERED + _clusters("k", "ordered", "tid, pos") + """ SELECT k.qname, concat(m.molecule, CASE WHEN k.earlier THEN '/A' ELSE '/B' END) AS mi FROM k JOIN mol m ON k.tid = m.tid AND k.pos = m.pos AND k.ordered = m.umi""")
def _(spark, d):
    return group.group(_narrow(spark, d), KEYS, "paired", 1, "dual").select("qname", "mi")


@query("group_command_cut", _T + """, g AS (SELECT *, substr(rx, 1, 2) AS umi FROM t) SELECT qname, CAST(dense_rank() OVER (ORDER BY tid, pos, r1, r2, umi) - 1 AS BIGINT) AS molecule FROM g""")
def _(spark, d):
    return group.group(_narrow(spark, d), KEYS, "identity", 0, "rx", min_umi_length=2).select("qname", "molecule")


_OUTCOMES = """, o AS (SELECT CASE WHEN mapq < 2 THEN 'low_mapq' WHEN mate_mapq < 2 THEN 'low_mate_mapq' WHEN raw_umi IS NULL THEN 'umi_missing' ELSE 'accepted' END AS outcome FROM t) SELECT outcome, count(*) AS templates FROM o GROUP BY outcome"""


@query("group_outcomes", _T + _OUTCOMES)
def _(spark, d):
    rows = templates(spark, d)
    grouped = group.group(rows, KEYS, "identity", 0, "raw_umi", _reason())
    return group.group_metrics(rows, grouped, KEYS, _reason())["filter"]


@query("dedup_command", _T + """, r AS (SELECT qname, line, CASE WHEN line < 7 THEN row_number() OVER (PARTITION BY line = 7, tid, pos, r1, r2, rx ORDER BY score DESC, qname) ELSE 1 END AS nth FROM t) SELECT qname, line = 7 AS passed_by FROM r WHERE nth = 1""")
def _(spark, d):
    rows = group.deduplicate(templates(spark, d), KEYS, strategy="identity", umi="rx", unmapped=F.col("line") == 7, remove=True)
    return rows.select("qname", F.col("molecule").isNull().alias("passed_by"))


_FILTER_COLUMNS = ["concat_ws(':', tid, pos, rx) AS template", "qname", "line", "seq", "qual", "CAST(1 + line % 4 AS INT) AS cD", "CAST((mapq % 12) / 400.0 AS FLOAT) AS cE"]
_PER_BASE = "CAST((line + {p} * 3) % 5 AS INT)", "CAST((mapq + {p}) % 7 = 0 AS INT)"


def _arrays(duck: bool) -> list[str]:
    wrap = "[{}]" if duck else "array({})"
    return [wrap.format(", ".join(e.format(p=p) for p in range(6))) + f" AS {n}" for e, n in zip(_PER_BASE, ("cd_", "ce_"), strict=True)]


@query(
    "filter_command",
    f""", f AS (SELECT {", ".join(_FILTER_COLUMNS + _arrays(True))} FROM reads),
   m AS (SELECT *, list_sum(qual) / len(qual) AS mean, list_transform(range(1, 7), lambda i: qual[i] < 14 OR cd_[i] < 1 OR (cd_[i] > 0 AND ce_[i] / cd_[i] > 0.4)) AS bad FROM f),
   n AS (SELECT *, list_transform(range(1, 7), lambda i: CASE WHEN bad[i] THEN 'N' ELSE substr(seq, CAST(i AS INT), 1) END) AS bases, len(list_filter(range(1, 7), lambda i: bad[i] AND substr(seq, CAST(i AS INT), 1) <> 'N')) AS newly FROM m),
   o AS (SELECT *, NOT (cD < 2 OR CAST(cE AS DOUBLE) > 0.025 OR mean < 15 OR len(list_filter(bases, lambda b: b = 'N')) > 6 * 0.6) AS passes FROM n),
   p AS (SELECT *, min(passes) OVER (PARTITION BY template) AS whole FROM o)
   SELECT qname, array_to_string(bases, '') AS seq, CAST(newly AS INT) AS newly FROM p WHERE whole""",
)
def _(spark, d):
    rows = reads(spark, d).selectExpr(*_FILTER_COLUMNS, *_arrays(False)).withColumnsRenamed({"cd_": "cd0", "ce_": "ce0"})
    # cD and cd differ in case alone: the per-base columns get names of their own
    rows = rows.select("template", "qname", "seq", "qual", F.col("cD").alias("cD"), F.col("cE").alias("cE"), F.col("cd0").alias("depths"), F.col("ce0").alias("errors"))
    kept, _ = filters.filter_reads(rows, (2, 1), (0.025,), (0.4,), 14, 15.0, 0.6, name="template", depths="depths", errors="errors", min_base_depth=1)
    return kept.select("qname", "seq", F.col("newly").cast("int").alias("newly"))


#: 32-bit Murmur3 of names, in steps that each use a value once or twice.
_MUL = "CAST((CAST({0} AS HUGEINT) * {1}) % 4294967296 AS BIGINT)"
_ROT = "((({0}) << {1}) & 4294967295 | (({0}) >> (32 - {1})))"
_MIXED = lambda k: f"list_transform(list_transform(list_transform({k}, lambda x: {_MUL.format('x', 3432918353)}), lambda x: {_ROT.format('x', 15)}), lambda x: {_MUL.format('x', 461845907)})"
NAME_HASH = f""", h0 AS (SELECT *, list_transform(range(1, len(qname) // 2 + 1), lambda i: CAST(ascii(substr(qname, CAST(2 * i - 1 AS INT), 1)) + ascii(substr(qname, CAST(2 * i AS INT), 1)) * 65536 AS BIGINT)) AS ks,
      CASE WHEN len(qname) % 2 = 1 THEN [CAST(ascii(substr(qname, CAST(len(qname) AS INT), 1)) AS BIGINT)] ELSE [] END AS odd FROM reads),
   h1 AS (SELECT *, list_reduce(list_prepend(CAST(42 AS BIGINT), {_MIXED("ks")}), lambda h, k: ({_MUL.format(_ROT.format("xor(h, k)", 13), 5)} + 3864292196) % 4294967296) AS g, {_MIXED("odd")} AS odd_mixed FROM h0),
   h2 AS (SELECT *, xor(CASE WHEN len(odd) = 1 THEN xor(g, odd_mixed[1]) ELSE g END, 2 * len(qname)) AS g2 FROM h1),
   h3 AS (SELECT *, {_MUL.format("xor(g2, g2 >> 16)", 2246822507)} AS g3 FROM h2), h4 AS (SELECT *, {_MUL.format("xor(g3, g3 >> 13)", 3266489909)} AS g4 FROM h3), h5 AS (SELECT *, xor(g4, g4 >> 16) AS g5 FROM h4),
   hashed AS (SELECT * EXCLUDE (ks, odd, g, odd_mixed, g2, g3, g4, g5), CASE WHEN g5 >= 2147483648 THEN g5 - 4294967296 ELSE g5 END AS name_hash FROM h5)"""


@query("name_rank_hash", NAME_HASH + " SELECT qname, CAST(name_hash AS INT) AS name_hash FROM hashed")
def _(spark, d):
    from molframe.functions.namehash import name_hash

    return reads(spark, d).select("qname", name_hash("qname").alias("name_hash"))


_FR = "(VALUES " + ", ".join(f"({f}::DOUBLE)" for f in metrics.FRACTIONS) + ") AS f(fraction)"
_NESTED = NAME_HASH + f", nested AS (SELECT fraction, tid, pos, rx, reverse FROM hashed JOIN {_FR} ON abs(name_hash) / 2147483647.0::DOUBLE <= fraction)"


@query(
    "simplex_yield",
    _NESTED
    + """, s AS (SELECT fraction, tid, pos, rx, count(*) AS n FROM nested GROUP BY ALL)
   SELECT fraction, CAST(sum(n) AS BIGINT) AS read_pairs, count(*) AS ss_families, sum(n) / count(*) AS mean_ss_family_size, count(*) FILTER (n = 1) AS ss_singletons, count(*) FILTER (n = 1) / count(*) AS ss_singleton_fraction,
      count(*) FILTER (n >= 2) AS ss_consensus_families FROM s GROUP BY fraction""",
)
def _(spark, d):
    sizes = metrics.nested_sizes(reads(spark, d), ["tid", "pos", "rx"], metrics.name_place(F.col("qname")), {"n": F.lit(True)})
    return metrics.simplex_yield(sizes, ["fraction"])


@query(
    "duplex_yield",
    _NESTED
    + """, s AS (SELECT fraction, tid, pos, rx, count(*) FILTER (reverse) AS a, count(*) FILTER (NOT reverse) AS b FROM nested GROUP BY ALL)
   SELECT fraction, count(*) AS ds_families, CAST(count(*) FILTER (a > 0) + count(*) FILTER (b > 0) AS BIGINT) AS ss_families, count(*) FILTER (a > 0 AND b > 0) AS ds_duplexes, count(*) FILTER (a > 0 AND b > 0) / count(*) AS ds_fraction_duplexes,
      round(sum(CASE WHEN a + b < 2 THEN 0 ELSE 1 - 2 / power(2.0::DOUBLE, a + b) END) / count(*), 9) AS ds_fraction_duplexes_ideal FROM s GROUP BY fraction""",
)
def _(spark, d):
    sizes = metrics.nested_sizes(reads(spark, d), ["tid", "pos", "rx"], metrics.name_place(F.col("qname")), {"a": F.col("reverse"), "b": ~F.col("reverse")})
    return metrics.duplex_yield(sizes, ["fraction"]).withColumn("ss_families", F.col("ss_families").cast("long")).withColumn("ds_fraction_duplexes_ideal", F.round("ds_fraction_duplexes_ideal", 9))


def _duplex_reads(spark, d):
    """The molecule is a position's UMI, its strand that of the read; the halves of the UMI are as the first read's strand has them."""
    rows = reads(spark, d).withColumn("mi", F.concat_ws("/", F.concat_ws(":", "tid", "pos", "rx"), F.when(F.col("reverse"), "A").otherwise("B")))
    return rows.select("tid", "pos", "qname", "mi", F.when(F.col("reverse"), F.col("dual")).otherwise(F.expr("concat(substring_index(dual, '-', -1), '-', substring_index(dual, '-', 1))")).alias("rx"), F.col("reverse").alias("r1_forward"))


_HALVES = """, one AS (SELECT u AS umi, count(*) AS raw, count(DISTINCT (tid, pos, rx)) AS n FROM (SELECT tid, pos, rx, split_part(dual, '-', 1) AS u FROM reads UNION ALL SELECT tid, pos, rx, split_part(dual, '-', 2) FROM reads) GROUP BY u)"""


@query("duplex_metrics_umis", _HALVES + """ SELECT umi, raw AS raw_observations, 0::BIGINT AS raw_observations_with_errors, n AS unique_observations, raw / sum(raw) OVER () AS fraction_raw_observations, n / sum(n) OVER () AS fraction_unique_observations FROM one""")
def _(spark, d):
    return metrics.duplex_metrics(_duplex_reads(spark, d), KEYS)["umi_counts"]


@query(
    "duplex_metrics_sizes",
    """, st AS (SELECT tid, pos, rx, count(*) FILTER (reverse) AS a, count(*) FILTER (NOT reverse) AS b FROM reads GROUP BY tid, pos, rx), c AS (SELECT greatest(a, b) AS ab_size, least(a, b) AS ba_size, count(*) AS "count" FROM st GROUP BY 1, 2)
   SELECT c.ab_size, c.ba_size, c."count", c."count" / (SELECT sum("count") FROM c) AS fraction, sum(o."count") / (SELECT sum("count") FROM c) AS fraction_gt_or_eq_size
   FROM c JOIN c o ON o.ab_size >= c.ab_size AND o.ba_size >= c.ba_size GROUP BY c.ab_size, c.ba_size, c."count" """,
)
def _(spark, d):
    return metrics.duplex_metrics(_duplex_reads(spark, d), KEYS)["duplex_family_sizes"]


@query("simplex_metrics_umis", """, c AS (SELECT rx AS umi, count(*) AS raw_observations, 0::BIGINT AS raw_observations_with_errors, count(DISTINCT (tid, pos)) AS unique_observations FROM reads GROUP BY rx)
   SELECT *, raw_observations / sum(raw_observations) OVER () AS fraction_raw_observations, unique_observations / sum(unique_observations) OVER () AS fraction_unique_observations FROM c""")  # fmt: skip
def _(spark, d):
    return metrics.simplex_metrics(reads(spark, d).withColumn("mi", F.concat_ws(":", "tid", "pos", "rx")), KEYS, least=2)["umi_counts"]


_SHAPES = {"6M": "6M", "3M1I2M": "3M1I2M", "2M1D4M": "2M1D4M", "2S4M": "6M"}
_SHAPE = "CASE line % 4 WHEN 0 THEN '6M' WHEN 1 THEN '3M1I2M' WHEN 2 THEN '2M1D4M' ELSE '2S4M' END"


@query(
    "majority_alignment",
    f""", a AS (SELECT *, {_SHAPE} AS cigar FROM reads), b AS (SELECT *, CASE cigar WHEN '2S4M' THEN '6M' ELSE cigar END AS shape FROM a), c AS (SELECT tid, pos, rx, shape, count(*) AS n FROM b GROUP BY ALL),
   e AS (SELECT *, row_number() OVER (PARTITION BY tid, pos, rx ORDER BY n DESC, CAST(substr(shape, 1, 1) AS INT)) AS place FROM c) SELECT b.qname, b.cigar FROM b JOIN e ON b.tid = e.tid AND b.pos = e.pos AND b.rx = e.rx AND b.shape = e.shape AND e.place = 1""",
)
def _(spark, d):
    from molframe.functions.align import cigar

    rows = reads(spark, d).withColumn("cigar", F.expr(_SHAPE)).withColumn("ops", cigar(F.col("cigar")))
    return consensus.majority_alignment(rows.select("tid", "pos", "rx", "qname", "cigar", "ops", "seq"), ["tid", "pos", "rx"]).select("qname", "cigar")


@query("consensus_statistics", """, x AS (SELECT CASE WHEN line = 7 THEN 'minority_alignment' WHEN line = 6 THEN 'insufficient_reads' END AS reason FROM reads), n AS (SELECT count(*) AS a, count(reason) AS g, count(*) FILTER (reason = 'minority_alignment') AS m, count(*) FILTER (reason = 'insufficient_reads') AS i FROM x),
   e AS (SELECT count(*) AS c FROM (SELECT DISTINCT tid, pos, rx FROM reads))
   SELECT key, value FROM (SELECT unnest(['raw_reads_considered', 'raw_reads_rejected', 'raw_reads_used', 'raw_reads_rejected_for_insufficient_support', 'raw_reads_rejected_for_minority_alignment', 'raw_reads_rejected_for_orphan_consensus', 'raw_reads_rejected_for_zero_bases_post_trimming', 'consensus_reads_emitted']) AS key,
      unnest([a, g, a - g, i, m, 0, 0, c])::VARCHAR AS value FROM n, e)""")  # fmt: skip
def _(spark, d):
    rows = reads(spark, d).withColumn("reason", F.when(F.col("line") == 7, "minority_alignment").when(F.col("line") == 6, "insufficient_reads"))
    out = metrics.consensus_statistics(rows, "reason", rows.select("tid", "pos", "rx").distinct())
    return out.filter("key <> 'frac_raw_reads_used'").select("key", "value")


_SITES = "(VALUES " + ", ".join(f"({t}, {s}, '{b}')" for t, s, b in ((1, 8, "A"), (2, 4, "C"), (3, 11, "G"), (0, 7, "T"))) + ") AS v(tid, site, ref)"
#: The place in the read of a reference offset, by shape: 0-based, -1 in the deletion, null outside.
_AT = """CASE line % 4 WHEN 0 THEN CASE WHEN o BETWEEN 0 AND 5 THEN o END WHEN 1 THEN CASE WHEN o BETWEEN 0 AND 2 THEN o WHEN o BETWEEN 3 AND 4 THEN o + 1 END
   WHEN 2 THEN CASE WHEN o BETWEEN 0 AND 1 THEN o WHEN o = 2 THEN -1 WHEN o BETWEEN 3 AND 6 THEN o - 1 END ELSE CASE WHEN o BETWEEN 0 AND 3 THEN o + 2 END END"""


def _gapped(spark, d):
    from molframe.functions.align import cigar

    return reads(spark, d).withColumn("ops", cigar(F.expr(_SHAPE))).withColumn("mi", F.concat_ws(":", "tid", "pos", "rx"))


@query("read_position", f", p AS (SELECT qname, line, pos % 9 AS o FROM reads) SELECT qname, CAST({_AT} AS BIGINT) AS place FROM p")
def _(spark, d):
    from molframe.functions.align import read_position

    return _gapped(spark, d).select("qname", read_position(F.col("pos"), F.col("ops"), F.col("pos") + F.col("pos") % 9).alias("place"))


@query("bases_at_sites", f""", p AS (SELECT v.*, r.qname, r.line, r.seq, v.site - r.pos AS o FROM reads r JOIN {_SITES} ON r.tid = v.tid), q AS (SELECT *, {_AT} AS place FROM p)
   SELECT site, tid, ref, qname, CASE WHEN place < 0 THEN '*' ELSE substr(seq, CAST(place + 1 AS INT), 1) END AS base FROM q WHERE place IS NOT NULL""")  # fmt: skip
def _(spark, d):
    from molframe.operators.order import bases_at

    sites = spark.createDataFrame([(1, 8, "A"), (2, 4, "C"), (3, 11, "G"), (0, 7, "T")], "tid int, site long, ref string")
    return bases_at(_gapped(spark, d), sites).select("site", "tid", "ref", "qname", "base")


@query("full_mate_info", """, m AS (SELECT *, CASE WHEN reverse THEN pos + 5 ELSE pos END AS x, CASE WHEN mate_reverse THEN mate_pos + 5 ELSE mate_pos END AS y, line = 7 AS u2, line = 6 AND ord % 2 = 0 AS u1 FROM reads)
   SELECT qname, 1 AS segment, CASE WHEN u1 AND NOT u2 THEN mate_pos ELSE pos END AS pos, CASE WHEN u2 AND NOT u1 THEN pos ELSE mate_pos END AS mate_pos, u2 AS mate_unmapped, CASE WHEN NOT u2 THEN mate_mapq END AS mq, CASE WHEN NOT u2 THEN '6M' END AS mc,
      CAST(CASE WHEN u1 OR u2 THEN 0 ELSE y - x + CASE WHEN y >= x THEN 1 ELSE -1 END END AS BIGINT) AS tlen FROM m
   UNION ALL SELECT qname, 2, CASE WHEN u2 AND NOT u1 THEN pos ELSE mate_pos END, CASE WHEN u1 AND NOT u2 THEN mate_pos ELSE pos END, u1, CASE WHEN NOT u1 THEN mapq END, CASE WHEN NOT u1 THEN '6M' END, CAST(CASE WHEN u1 OR u2 THEN 0 ELSE x - y + CASE WHEN x >= y THEN 1 ELSE -1 END END AS BIGINT) FROM m""")  # fmt: skip
def _(spark, d):
    from molframe.operators.order import full_mate_info

    rows = reads(spark, d)
    one = rows.select("qname", F.lit(1).alias("segment"), "tid", "pos", "reverse", "mapq", ((F.col("line") == 6) & (F.col("ord") % 2 == 0)).alias("unmapped"))
    two = rows.select("qname", F.lit(2).alias("segment"), "tid", F.col("mate_pos").alias("pos"), F.col("mate_reverse").alias("reverse"), F.col("mate_mapq").alias("mapq"), (F.col("line") == 7).alias("unmapped"))
    out = full_mate_info(one.union(two).withColumn("end", F.col("pos") + 5).withColumn("cigar", F.lit("6M")))
    return out.select("qname", "segment", "pos", "mate_pos", "mate_unmapped", "mq", "mc", "tlen")


_CLIPPED = """, p AS (SELECT pos + 1 AS s1, pos + 4 AS e1, pos + line - 3 AS s2, pos + line + 1 AS e2 FROM reads), q AS (SELECT *, greatest(s1, s2) <= least(e1, e2) AS meet, (s1 + 1 + e2 + 1) // 2 - 1 AS m0 FROM p),
   k AS (SELECT *, CASE WHEN m0 > e1 THEN e1 WHEN m0 < s2 THEN s2 - 1 ELSE m0 END AS mid FROM q),
   n AS (SELECT CASE WHEN meet THEN greatest(0, least(4, e1 - mid)) ELSE 0 END AS o1, CASE WHEN meet THEN greatest(0, least(5, mid + 1 - s2)) ELSE 0 END AS o2 FROM k),
   r AS (SELECT ['ReadOne', 'Pair', 'All'] AS kinds, 1 AS five, o1 AS o, o1 = 4 AS gone, CASE WHEN o1 = 4 THEN 6 ELSE 2 + o1 END AS post FROM n UNION ALL SELECT ['ReadTwo', 'Pair', 'All'], 0, o2, o2 = 5, CASE WHEN o2 = 5 THEN 6 ELSE 1 + o2 END FROM n),
   t AS (SELECT unnest(kinds) AS read_type, * EXCLUDE (kinds) FROM r UNION ALL SELECT 'Fragment', NULL, NULL, NULL, NULL)
   SELECT read_type, count(o) AS reads, count(*) FILTER (gone) AS reads_unmapped, count(o) AS reads_clipped_pre, count(o) AS reads_clipped_post, coalesce(sum(five), 0)::BIGINT AS reads_clipped_five_prime, 0::BIGINT AS reads_clipped_three_prime, count(*) FILTER (o > 0) AS reads_clipped_overlapping,
      0::BIGINT AS reads_clipped_extending, 6 * count(o) AS bases, count(o) AS bases_clipped_pre, coalesce(sum(post), 0)::BIGINT AS bases_clipped_post, coalesce(sum(five), 0)::BIGINT AS bases_clipped_five_prime, 0::BIGINT AS bases_clipped_three_prime, coalesce(sum(o), 0)::BIGINT AS bases_clipped_overlapping, 0::BIGINT AS bases_clipped_extending
   FROM t GROUP BY read_type"""
SQL["clip_pairs"] = DUCK + _CLIPPED


_CODEC = """, p AS (SELECT qname, line, pos AS pos1, pos + line - 3 AS pos2 FROM reads)"""


@query(
    "codec_reason",
    _CODEC
    + """, c AS (SELECT *, CASE WHEN line = 5 THEN 7 ELSE 5 END AS reach, greatest(pos1, pos2) AS a, least(pos1 + CASE WHEN line = 5 THEN 6 ELSE 5 END, pos2 + 5) AS b FROM p)
   SELECT qname, CASE WHEN pos1 > pos2 + 5 THEN 'not_primary_fr_pair' WHEN b - a + 1 < 4 THEN 'insufficient_overlap' WHEN line = 5 AND a <= pos1 + 2 AND b >= pos1 + 2 THEN 'indel_error_between_strands' END AS reason FROM c""",
)
def _(spark, d):
    from molframe.functions.align import cigar

    p = reads(spark, d).select("qname", F.col("pos").alias("pos1"), (F.col("pos") + F.col("line") - 3).alias("pos2"), cigar(F.when(F.col("line") == 5, "2M1D4M").otherwise("6M")).alias("ops1"))
    reason = consensus.codec_reason(F.col("pos1"), F.col("ops1"), F.lit(False), F.col("pos2"), cigar(F.lit("6M")), F.lit(True), F.lit(True), 4)
    return p.select("qname", reason.alias("reason"))


_QUAL_TEXT = "list_aggregate(list_transform(qual, lambda q: chr(q + 33)), 'string_agg', '')"


@query("extract_with_qualities", f""", q AS (SELECT *, {_QUAL_TEXT} AS qt FROM reads) SELECT concat(qname, '+', rx, '-', substr(seq, 1, 3), '-', substr(seq, 6, 1)) AS name, concat(rx, '-', substr(seq, 1, 3), '-', substr(seq, 6, 1)) AS umi, concat(substr(qt, 1, 3), ' ', substr(qt, 6, 1)) AS umi_qual,
   substr(seq, 4, 2) AS template_1, substr(qt, 4, 2) AS template_1_qual, 'N' AS template_2, '#' AS template_2_qual, 'A' AS rg FROM q""")  # fmt: skip
def _(spark, d):
    from molframe.sources.text import phred_text

    rows = reads(spark, d).select(F.col("qname").alias("name"), "rx", "seq", phred_text(F.col("qual")).alias("qt"), F.substring("dual", 1, 2).alias("short"), F.lit("!!").alias("short_qual"))
    out = template.extract(rows, {"seq": "3M+T1M", "short": "2S+T"}, F.col("rx"), {"seq": "qt", "short": "short_qual"}, annotate="name", read_group="A")
    return out.select("name", "umi", "umi_qual", "template_1", "template_1_qual", "template_2", "template_2_qual", "rg")


@query(
    "template_reasons",
    """, p AS (SELECT qname, line <> 5 AS present1, line <> 4 AS present2, line = 3 AND ord % 3 = 0 AS unmapped1, line = 3 AND ord % 2 = 0 AS unmapped2, mapq % 11 = 0 AS qc_fail1, mate_mapq % 13 = 0 AS qc_fail2, mapq AS mapq1, mate_mapq AS mapq2, raw_umi FROM reads)
   SELECT qname, CASE WHEN (NOT present1 OR unmapped1) AND (NOT present2 OR unmapped2) THEN 'fully_unmapped' WHEN present1 AND qc_fail1 THEN 'non_pf' WHEN present1 AND NOT unmapped1 AND mapq1 < 9 THEN 'low_mapq' WHEN present2 AND qc_fail2 THEN 'non_pf' WHEN present2 AND NOT unmapped2 AND mapq2 < 9 THEN 'low_mapq'
      WHEN present1 AND NOT unmapped2 AND mapq2 < 9 THEN 'low_mate_mapq' WHEN contains(raw_umi, 'N') THEN 'umi_has_n' WHEN raw_umi IS NULL AND present1 THEN 'umi_missing' WHEN present2 AND NOT unmapped1 AND mapq1 < 9 THEN 'low_mate_mapq' WHEN raw_umi IS NULL THEN 'umi_missing' END AS reason FROM p""",
)
def _(spark, d):
    cols = "qname, line <> 5 AS present1, line <> 4 AS present2, line = 3 AND ord % 3 = 0 AS unmapped1, line = 3 AND ord % 2 = 0 AS unmapped2, mapq % 11 = 0 AS qc_fail1, mate_mapq % 13 = 0 AS qc_fail2, mapq AS mapq1, mate_mapq AS mapq2, mate_mapq AS mate_mapq1, mapq AS mate_mapq2, raw_umi"
    rows = reads(spark, d).selectExpr(*cols.split(", "))
    return rows.select("qname", template.template_reason(F.col("raw_umi"), 9).alias("reason"))
