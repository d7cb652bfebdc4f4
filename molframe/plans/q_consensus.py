"""Queries on consensus building, filters, clipping, order and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe.functions import phred
from molframe.functions.align import natural_key
from molframe.operators import consensus, filters, order
from molframe.operators.clip import overlap_midpoint
from molframe.operators.numbering import numbered
from molframe.plans.q_basic import _FLAG
from molframe.plans.readview import DUCK, LENGTH, reads

QUERIES: dict = {}
SQL: dict = {}
PRE, POST = 45, 40


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = DUCK + sql
        return f

    return keep


def _tables_sql(pre: int, post: int) -> str:
    """The error model from its formulas, in SQL alone: by quality, lists of the log-likelihoods of a right and of a wrong base, and of the quality of a single read."""
    two = "CASE WHEN greatest({0}, {1}) - least({0}, {1}) >= 6 THEN greatest({0}, {1}) ELSE ln(exp({0}) + exp({1}) - 4.0e0 / 3 * exp({0} + {1})) END"
    return f"""SELECT list(CASE WHEN t >= 0 THEN '-inf'::DOUBLE ELSE ln(1 - exp(t)) END ORDER BY q) AS ln_right, list(t - ln(3) ORDER BY q) AS ln_wrong,
      list(CAST(CASE WHEN s < -9.3e0 * ln(10) THEN 93 ELSE least(93, greatest(2, floor(-10 * s / ln(10) + 0.001e0))) END AS INT) ORDER BY q) AS single
      FROM (SELECT q, {two.format("p", "e")} AS t, {two.format("m", "e")} AS s FROM (SELECT q, -{post} * ln(10) / 10 AS p, -{min(pre, post)} * ln(10) / 10 AS m, -q * ln(10) / 10 AS e FROM range(94) AS r(q)))"""


def _consensus_sql(family: str, pre: int = PRE, post: int = POST, min_qual: int = 12, source: str = "reads", name: str = "con") -> str:
    """CTEs that end in `con`: (family, at, base, qual, depth, errors)."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in family.split(", "))
    scores = ", ".join(f"list_reduce(list_prepend(0.0e0, list_transform(l, lambda x: CASE WHEN x.{b} > 0 THEN x.{b} * ln_right[x.q + 1] ELSE 0.0e0 END + (x.a + x.c + x.g + x.t - x.{b}) * ln_wrong[x.q + 1])), lambda u, y: u + y)" for b in "acgt")
    pre_e, most = phred.ln_error(pre), phred.ln_error(phred.MOST)
    return f""", {name}_tab AS ({_tables_sql(pre, post)}), {name}_p AS (SELECT {family}, "at", CASE WHEN qual["at" + 1] < {min_qual} THEN 'N' ELSE substr(seq, "at" + 1, 1) END AS base, CASE WHEN qual["at" + 1] < {min_qual} THEN 2 ELSE qual["at" + 1] END AS q FROM {source}, range({LENGTH}) AS t("at")),
   {name}_f AS (SELECT {family}, count(*) AS members FROM {source} GROUP BY ALL),
   {name}_c AS (SELECT {family}, "at", q, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, min(base) AS least_base FROM {name}_p GROUP BY ALL),
   {name}_l AS (SELECT {family}, "at", sum(a + c + g + t) AS depth, coalesce(list({{'q': q, 'a': a, 'c': c, 'g': g, 't': t}} ORDER BY q) FILTER (a + c + g + t > 0), []) AS l, min(least_base) AS only_base, min(q) AS only_q FROM {name}_c GROUP BY ALL),
   {name}_s AS (SELECT *, [{scores}] AS sc FROM {name}_l, {name}_tab),
   {name}_b AS (SELECT *, list_max(sc) AS best, list_position(sc, list_max(sc)) AS place FROM {name}_s),
   {name}_o AS (SELECT *, len(list_filter(range(1, 5), lambda i: i > place AND abs(sc[i] - best) <= 2.220446049250313e-16)) AS ties, list_sum(list_transform(range(1, 5), lambda i: CASE WHEN i = place THEN 0.0e0 ELSE exp(sc[i] - best) END)) AS others FROM {name}_b),
   {name}_e AS (SELECT *, CASE WHEN others = 0 THEN {pre_e!r}e0 ELSE ln(others) - ln(1 + others) END AS wrong FROM {name}_o),
   {name}_t AS (SELECT *, greatest(wrong, {pre_e!r}e0) AS hi, least(wrong, {pre_e!r}e0) AS lo FROM {name}_e),
   {name}_u AS (SELECT *, CASE WHEN others = 0 THEN {pre_e!r}e0 WHEN hi - lo >= 6 THEN hi ELSE ln(exp(hi) + exp(lo) - 4.0e0 / 3 * exp(hi + lo)) END AS both_ FROM {name}_t),
   {name}_v AS (SELECT *, CASE WHEN depth = 0 OR ties > 0 THEN 2 WHEN both_ < {most!r}e0 THEN 93 ELSE least(93, greatest(2, CAST(floor(both_ * -4.3429448190325175e0 + 0.001) AS INT))) END AS called_q,
       CASE WHEN depth = 0 OR ties > 0 THEN 'N' ELSE substr('ACGT', CAST(place AS INT), 1) END AS called_b FROM {name}_u),
   {name} AS (SELECT {", ".join(f"v.{k}" for k in family.split(", "))}, v."at", CASE WHEN members = 1 THEN only_base ELSE called_b END AS base,
       CAST(CASE WHEN members = 1 THEN single[only_q + 1] WHEN depth < 1 THEN 0 ELSE called_q END AS INT) AS qual, CAST(depth AS INT) AS depth,
       CAST(CASE WHEN members = 1 THEN 0 ELSE depth - coalesce(list_sum(list_transform(l, lambda x: CASE called_b WHEN 'A' THEN x.a WHEN 'C' THEN x.c WHEN 'G' THEN x.g WHEN 'T' THEN x.t ELSE 0 END)), 0) END AS INT) AS errors
       FROM {name}_v v JOIN {name}_f f ON {same("v", "f")})"""


_FAM = "tid, pos, rx"


#: The quality below which a base is N.
MASK = 12


@query("consensus_positions", _consensus_sql(_FAM) + """ SELECT tid, pos, rx, CAST("at" AS INT) AS "at", base, qual, depth, errors FROM con""")
def _(spark, d):
    return consensus.consensus_positions(reads(spark, d), _FAM.split(", "), mask=MASK)


@query(
    "simplex_consensus",
    _consensus_sql(_FAM)
    + """ SELECT tid, pos, rx, string_agg(base, '' ORDER BY "at") AS seq, string_agg(qual::VARCHAR, ',' ORDER BY "at") AS qual, max(depth) AS cD, min(depth) AS cM, CAST(coalesce(sum(errors) / nullif(sum(depth), 0), 0) AS FLOAT) AS cE FROM con GROUP BY tid, pos, rx""",
)
def _(spark, d):
    rows = consensus.simplex(reads(spark, d), _FAM.split(", "), mask=MASK)
    return rows.select(*_FAM.split(", "), "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), "cD", "cM", "cE")


@query(
    "duplex_consensus",
    ", stranded AS (SELECT *, CASE WHEN reverse THEN 'A' ELSE 'B' END AS strand FROM reads)"
    + _consensus_sql("tid, pos, rx, strand", source="stranded")
    + """, j AS (SELECT a.tid, a.pos, a.rx, a."at", a.base AS ab, b.base AS bb, a.qual AS aq, b.qual AS bq, a.depth AS ad, b.depth AS bd, a.errors AS ae, b.errors AS be FROM con a JOIN con b ON a.tid = b.tid AND a.pos = b.pos AND a.rx = b.rx AND a."at" = b."at" AND a.strand = 'A' AND b.strand = 'B'),
   k AS (SELECT *, CASE WHEN ab = bb OR aq >= bq THEN ab ELSE bb END AS raw, CASE WHEN ab = bb THEN least(93, aq + bq) WHEN aq = bq THEN 2 ELSE greatest(2, abs(aq - bq)) END AS rq FROM j),
   m AS (SELECT *, ab = 'N' OR bb = 'N' OR rq = 2 AS void, CASE WHEN ab = bb THEN ae + be WHEN raw = ab THEN ae + bd - be ELSE be + ad - ae END AS err FROM k)
   SELECT tid, pos, rx, string_agg(CASE WHEN void THEN 'N' ELSE raw END, '' ORDER BY "at") AS seq, string_agg((CASE WHEN void THEN 2 ELSE rq END)::VARCHAR, ',' ORDER BY "at") AS qual, CAST(max(ad + bd) AS INT) AS cD, string_agg(ab, '' ORDER BY "at") AS ac, string_agg(bb, '' ORDER BY "at") AS bc, CAST(sum(err) AS BIGINT) AS errors
   FROM m GROUP BY tid, pos, rx""",
)
def _(spark, d):
    rows = reads(spark, d).withColumn("strand", F.when(F.col("reverse"), "A").otherwise("B"))
    out = consensus.duplex(rows, _FAM.split(", "), mask=MASK)
    return out.select(*_FAM.split(", "), "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), F.array_max("depths").alias("cD"), "ac", "bc", F.aggregate("errors", F.lit(0).cast("long"), lambda s, e: s + e).alias("errors"))


@query(
    "umi_consensus",
    ", flat AS (SELECT tid, pos, rg, rx AS seq, [20, 20, 20, 20, 20, 20] AS qual FROM reads)"
    + _consensus_sql("tid, pos, rg", 90, 90, source="(SELECT tid, pos, rg, concat(seq, 'NN') AS seq, qual FROM flat)", min_qual=2)
    + """ SELECT tid, pos, rg, string_agg(base, '' ORDER BY "at") AS umi FROM con WHERE "at" < 4 GROUP BY tid, pos, rg""",
)
def _(spark, d):
    return consensus.umi_consensus(reads(spark, d), ["tid", "pos", "rg"]).select("tid", "pos", "rg", "umi")


_PAIR = ", pr AS (SELECT qname, pos AS pos1, seq AS seq1, qual AS qual1, pos + line - 3 AS pos2, concat(substr(seq, 2), 'A') AS seq2, list_reverse(qual) AS qual2 FROM reads)"


def _pairs(spark, d):
    return reads(spark, d).select("qname", F.col("pos").alias("pos1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), (F.col("pos") + F.col("line") - 3).alias("pos2"), F.concat(F.substring("seq", 2, 99), F.lit("A")).alias("seq2"), F.reverse("qual").alias("qual2"))


_OVER = """, o AS (SELECT qname, i AS "at", substr(seq1, CAST(i + 1 AS INT), 1) AS b1, qual1[i + 1] AS q1, CASE WHEN pos1 + i - pos2 BETWEEN 0 AND 5 THEN substr(seq2, CAST(pos1 + i - pos2 + 1 AS INT), 1) END AS b2, CASE WHEN pos1 + i - pos2 BETWEEN 0 AND 5 THEN qual2[pos1 + i - pos2 + 1] END AS q2 FROM pr, range(6) AS t(i))"""


@query(
    "overlap_consensus",
    _PAIR + _OVER
    + """ SELECT qname, string_agg(CASE WHEN b2 IS NULL OR b1 = b2 THEN b1 WHEN q1 = q2 THEN 'N' WHEN q1 > q2 THEN b1 ELSE b2 END, '' ORDER BY "at") AS seq1,
   string_agg((CASE WHEN b2 IS NULL THEN q1 WHEN b1 = b2 THEN least(93, q1 + q2) ELSE greatest(2, abs(q1 - q2)) END)::VARCHAR, ',' ORDER BY "at") AS qual1 FROM o GROUP BY qname""",
)
def _(spark, d):
    return consensus.call_overlaps(_pairs(spark, d), ["qname"]).select("qname", "seq1", F.array_join(F.col("qual1").cast("array<string>"), ",").alias("qual1"))


@query(
    "overlap_mask_lower",
    _PAIR + _OVER
    + """ SELECT qname, string_agg(CASE WHEN b2 IS NULL OR b1 = b2 OR q1 > q2 THEN b1 ELSE 'N' END, '' ORDER BY "at") AS seq1,
   string_agg((CASE WHEN b2 IS NULL THEN q1 WHEN b1 = b2 THEN greatest(q1, q2) WHEN q1 > q2 THEN q1 ELSE 2 END)::VARCHAR, ',' ORDER BY "at") AS qual1 FROM o GROUP BY qname""",
)
def _(spark, d):
    out = consensus.call_overlaps(_pairs(spark, d), ["qname"], agreement="max-qual", disagreement="mask-lower-qual")
    return out.select("qname", "seq1", F.array_join(F.col("qual1").cast("array<string>"), ",").alias("qual1"))


@query(
    "codec_consensus",
    _PAIR
    + """, c AS (SELECT qname, r, CASE WHEN r - pos1 BETWEEN 0 AND 5 THEN substr(seq1, CAST(r - pos1 + 1 AS INT), 1) END AS a, CASE WHEN r - pos2 BETWEEN 0 AND 5 THEN substr(seq2, CAST(r - pos2 + 1 AS INT), 1) END AS b, qual1[r - pos1 + 1] AS qa, qual2[r - pos2 + 1] AS qb
      FROM (SELECT *, unnest(range(least(pos1, pos2), greatest(pos1, pos2) + 6)) AS r FROM pr)),
   x AS (SELECT qname, r, a IS NOT NULL AND b IS NOT NULL AS dup, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a WHEN qa = qb OR abs(qa - qb) <= 2 THEN 'N' WHEN qa > qb THEN a ELSE b END AS base,
      CASE WHEN a IS NULL THEN least(qb, 20) WHEN b IS NULL THEN least(qa, 20) WHEN a = b THEN least(93, qa + qb) WHEN qa = qb THEN 2 ELSE greatest(2, abs(qa - qb)) END AS q FROM c)
   SELECT qname, string_agg(base, '' ORDER BY r) AS seq, string_agg(CAST(q AS VARCHAR), ',' ORDER BY r) AS qual, CAST(count(*) FILTER (dup) AS INT) AS duplex_bases FROM x GROUP BY qname HAVING count(*) FILTER (dup) >= 3""",
)
def _(spark, d):
    out = consensus.codec(_pairs(spark, d), ["qname"], single_qual=20, min_duplex=3)
    return out.select("qname", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), "duplex_bases")


@query("capped_reads", """ SELECT qname FROM (SELECT *, row_number() OVER (PARTITION BY tid, pos, rx ORDER BY score, ord, qname) AS r FROM reads) WHERE r <= 2""")
def _(spark, d):
    return consensus.capped_reads(reads(spark, d).withColumn("tie", F.struct("ord", "qname")), ["tid", "pos", "rx"], 2, F.col("score"), order="tie").select("qname")


_ARRAYS = {k: (f"transform(sequence(0, {LENGTH - 1}), p -> {e})", f"list_transform(range({LENGTH}), lambda p: CAST({e} AS INT))") for k, e in {"cd": "(line + p) % 6", "ce": "(ord + p) % 3", "ad": "(line + p) % 4", "ae": "(ord + p) % 2", "bd": "(line + 2 * p) % 5", "be": "(ord + 2 * p) % 2"}.items()}
_TAGGED = ", tagged AS (SELECT *, " + ", ".join(f"{d} AS {k}" for k, (_, d) in _ARRAYS.items()) + ", reverse(seq) AS bc, seq AS ac FROM reads)"


def _tagged(spark, d):
    return reads(spark, d).selectExpr("*", *[f"CAST({s} AS array<int>) AS {k}" for k, (s, _) in _ARRAYS.items()], "seq AS ac", "reverse(seq) AS bc")


def _mask_sql(test: str) -> str:
    return (
        _TAGGED
        + f""", b AS (SELECT qname, p, substr(seq, CAST(p + 1 AS INT), 1) AS s, qual[p + 1] AS q, cd[p + 1] AS cd, ce[p + 1] AS ce, ad[p + 1] AS a, bd[p + 1] AS b, ae[p + 1] AS ea, be[p + 1] AS eb, substr(ac, CAST(p + 1 AS INT), 1) AS ac, substr(bc, CAST(p + 1 AS INT), 1) AS bc FROM tagged, range({LENGTH}) AS t(p)),
   r AS (SELECT *, CASE WHEN a > 0 THEN ea / a ELSE 0 END AS ra, CASE WHEN b > 0 THEN eb / b ELSE 0 END AS rb, CASE WHEN a + b > 0 THEN (ea + eb) / (a + b) ELSE 0 END AS rt FROM b), m AS (SELECT *, {test} AS bad FROM r)
   SELECT qname, string_agg(CASE WHEN bad THEN 'N' ELSE s END, '' ORDER BY p) AS seq, string_agg((CASE WHEN bad THEN 2 ELSE q END)::VARCHAR, ',' ORDER BY p) AS qual, CAST(count(*) FILTER (bad) AS INT) AS newly FROM m GROUP BY qname"""
    )


@query("mask_simplex", _mask_sql("q < 14 OR cd < 2 OR (cd > 0 AND ce / cd > 0.4)"))
def _(spark, d):
    return filters.mask_simplex(_tagged(spark, d), 2, 0.4, 14).select("qname", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), "newly")


@query("mask_duplex", _mask_sql("q < 12 OR a + b < 3 OR rt > 0.5 OR greatest(a, b) < 2 OR least(ra, rb) > 0.4 OR least(a, b) < 1 OR greatest(ra, rb) > 0.6 OR (a > 0 AND b > 0 AND ac <> bc)"))
def _(spark, d):
    out = filters.mask_duplex(_tagged(spark, d), (3, 2, 1), (0.5, 0.4, 0.6), 12, agreement=True)
    return out.select("qname", "seq", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"), "newly")


@query("filter_simplex", """ SELECT CASE WHEN line < 3 THEN 'insufficient_reads' WHEN mapq / 100.0::DOUBLE > 0.3 THEN 'excessive_error_rate' END AS reason, count(*) AS n FROM reads GROUP BY 1""")
def _(spark, d):
    return reads(spark, d).groupBy(filters.simplex_reason(F.col("line"), F.col("mapq") / 100, 3, 0.3).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "filter_duplex",
    """, t AS (SELECT line AS cd, mapq / 200.0::DOUBLE AS ce, line % 4 AS ad, CAST(ord % 5 AS INT) AS bd, mapq / 100.0::DOUBLE AS ae, mate_mapq / 100.0::DOUBLE AS be FROM reads)
   SELECT CASE WHEN cd < 2 THEN 'insufficient_reads' WHEN ce > 0.2 THEN 'excessive_error_rate' WHEN greatest(ad, bd) < 2 THEN 'insufficient_reads' WHEN least(ae, be) > 0.2 THEN 'excessive_error_rate'
      WHEN least(ad, bd) < 1 THEN 'insufficient_reads' WHEN greatest(ae, be) > 0.4 THEN 'excessive_error_rate' END AS reason, count(*) AS n FROM t GROUP BY 1""",
)
def _(spark, d):
    t = reads(spark, d).selectExpr("line AS cd", "mapq / 200 AS ce", "line % 4 AS ad", "CAST(ord % 5 AS INT) AS bd", "mapq / 100 AS ae", "mate_mapq / 100 AS be")
    c = F.col
    return t.groupBy(filters.duplex_reason(c("cd"), c("ce"), c("ad"), c("ae"), c("bd"), c("be"), (2, 2, 1), (0.2, 0.2, 0.4)).alias("reason")).agg(F.count("*").alias("n"))


@query("no_calls", """ SELECT qname, CAST(length(raw) - length(replace(raw, 'N', '')) AS INT) AS n, (length(raw) - length(replace(raw, 'N', ''))) > length(raw) * 0.2 AS too_many, list_sum(qual) / len(qual) AS mean_qual FROM (SELECT *, replace(seq, 'T', 'N') AS raw FROM reads)""")
def _(spark, d):
    raw = F.translate("seq", "T", "N")
    return reads(spark, d).select("qname", filters.no_calls(raw).alias("n"), filters.too_many_no_calls(raw, 0.2).alias("too_many"), filters.mean_quality(F.col("qual")).alias("mean_qual"))


@query("template_level_filter", """ SELECT qname FROM (SELECT qname, min(CASE WHEN line < 6 THEN mapq > 25 END) OVER (PARTITION BY ord) AS kept FROM reads) WHERE kept""")
def _(spark, d):
    return filters.whole_templates(reads(spark, d), F.col("mapq") > 25, name="ord", is_primary=F.col("line") < 6).select("qname")


@query("methylation_mask", """, m AS (SELECT qname, p, substr(seq, CAST(p + 1 AS INT), 1) AS s, (line + p) % 6 + (ord + p) % 3 AS t FROM reads, range(6) AS t(p)) SELECT qname, string_agg(CASE WHEN t > 0 AND t < 3 THEN 'N' ELSE s END, '' ORDER BY p) AS seq FROM m GROUP BY qname""")
def _(spark, d):
    return filters.methylation_mask(_tagged(spark, d), 3, "cd", "ce").select("qname", "seq")


@query(
    "conversion_fraction",
    """, m AS (SELECT qname, (line + p) % 6 AS u, (ord + p) % 3 AS c, substr(seq, CAST(p + 1 AS INT), 1) = 'C' AND substr(seq, CAST(p + 2 AS INT), 1) <> 'G' AS site FROM reads, range(6) AS t(p))
   SELECT qname, sum(c) FILTER (site) / nullif(sum(u + c) FILTER (site), 0) AS fraction FROM m GROUP BY qname""",
)
def _(spark, d):
    return _tagged(spark, d).select("qname", filters.conversion_fraction(F.col("seq"), F.col("cd"), F.col("ce")).alias("fraction"))


@query(
    "methylation_counts",
    """, p AS (SELECT pos, rx, "at", substr(seq, CAST("at" + 1 AS INT), 1) AS base, pos + "at" AS ref_pos FROM reads, range(6) AS t("at"))
   SELECT pos, rx, CAST("at" AS INT) AS "at", count(*) FILTER (base = 'C') AS unconverted, count(*) FILTER (base = 'T') AS converted FROM p WHERE ref_pos % 3 = 1 GROUP BY pos, rx, "at" """,
)
def _(spark, d):
    rows = reads(spark, d)
    places = rows.select("pos", "rx", F.lit(0).alias("tid"), F.posexplode(F.split("seq", "")).alias("at", "base")).withColumn("ref_pos", F.col("pos") + F.col("at"))
    reference = places.select("tid", "ref_pos").distinct().withColumn("ref", F.when(F.col("ref_pos") % 3 == 1, "C").otherwise("A"))
    return order.methylation(places, reference, ["pos", "rx"])


_ORDERED = """ SELECT qname, row_number() OVER (ORDER BY {}) - 1 AS place FROM reads"""


def _place(df, keys):
    """Each row's place in an order, as the last of its keys is unique."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select("qname", *[k.alias(n) for n, k in zip(names, keys, strict=True)])
    return numbered(rows, names).select("qname", "place")


@query("sort_coordinate", _ORDERED.format("tid, pos, reverse, qname"))
def _(spark, d):
    return _place(reads(spark, d), [*order.sort_keys("coordinate"), F.col("qname")])


@query("sort_queryname", f", f AS (SELECT *, {_FLAG} AS flag FROM reads) SELECT qname, row_number() OVER (ORDER BY qname) - 1 AS place FROM f")
def _(spark, d):
    return _place(reads(spark, d).withColumn("flag", F.expr(_FLAG).cast("int")), order.sort_keys("queryname"))


@query("sort_queryname_natural", """ SELECT ord, line, row_number() OVER (ORDER BY ord, line, qname) - 1 AS place FROM reads""")
def _(spark, d):
    rows = reads(spark, d).withColumn("name", F.concat(F.lit("r"), F.col("ord"), F.lit("x"), F.col("line")))
    placed = numbered(rows.select("ord", "line", "qname", natural_key(F.col("name")).alias("key")), ["key", "qname"])
    return placed.select("ord", "line", "place")


@query("sort_template_coordinate", _ORDERED.format("tid, least(pos, mate_pos), greatest(pos, mate_pos), CASE WHEN pos <= mate_pos THEN NOT reverse ELSE NOT mate_reverse END, CASE WHEN pos <= mate_pos THEN NOT mate_reverse ELSE NOT reverse END, rg, library, ord, qname"))
def _(spark, d):
    rows = reads(spark, d).withColumn("mate_tid", F.col("tid")).withColumn("cell", F.col("rg")).withColumn("mi", F.col("ord"))
    return _place(rows, order.sort_keys("template-coordinate"))


_NUMBERED = ", k AS (SELECT *, row_number() OVER (ORDER BY ord, qname) - 1 AS o FROM reads)"


@query("sort_verify", _NUMBERED + """, l AS (SELECT *, lag(tid) OVER w AS t0, lag(pos) OVER w AS p0, lag(reverse) OVER w AS r0 FROM k WINDOW w AS (ORDER BY o)) SELECT qname FROM l WHERE t0 IS NOT NULL AND (tid, pos, reverse) < (t0, p0, r0)""")
def _(spark, d):
    rows = numbered(reads(spark, d).select("ord", "qname", "tid", "pos", "reverse"), ["ord", "qname"], "o")
    return order.out_of_order(rows, "coordinate", ordinal="o", parts=1000).select("qname")


@query("merge_reads", """ SELECT qname, CASE WHEN rg = 'A' THEN mapq END AS mapq, tid FROM reads""")
def _(spark, d):
    rows = reads(spark, d).withColumn("flag", F.lit(0))
    a, b = rows.filter("rg = 'A'").select("qname", "flag", "mapq", "tid"), rows.filter("rg <> 'A'").select("tid", "qname", "flag")
    return order.merge_reads([a, b], "queryname").select("qname", "mapq", "tid")


@query("compare_content", """ SELECT qname, CASE WHEN line = 1 THEN 'left' WHEN line = 2 THEN 'right' ELSE 'both' END AS side, CASE WHEN line IN (1, 2) THEN '' ELSE 'mapq' END AS columns FROM reads WHERE line IN (1, 2) OR mapq % 7 = 0""")
def _(spark, d):
    rows = reads(spark, d).select("qname", "line", "mapq", "rx")
    a, b = rows.filter("line <> 2"), rows.filter("line <> 1").withColumn("mapq", F.when((F.col("mapq") % 7 == 0) & ~F.col("line").isin(1, 2), -1).otherwise(F.col("mapq")))
    return order.compare_content(a, b, ["qname"]).withColumn("columns", F.array_join("columns", ","))


@query("compare_multisets", """, a AS (SELECT rx, count(*) AS n FROM reads GROUP BY rx), b AS (SELECT rx, count(*) AS n FROM reads WHERE line <> 3 GROUP BY rx) SELECT a.rx, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS difference FROM a LEFT JOIN b ON a.rx = b.rx WHERE a.n <> coalesce(b.n, 0)""")
def _(spark, d):
    rows = reads(spark, d)
    return order.compare_multisets(rows.select("rx"), rows.filter("line <> 3").select("rx"))


@query(
    "compare_molecules",
    """, a AS (SELECT min(qname) AS least, count(*) AS n, list(qname ORDER BY qname) AS l FROM reads GROUP BY tid, pos, rx), b AS (SELECT min(qname) AS least, count(*) AS n, list(qname ORDER BY qname) AS l FROM reads GROUP BY tid, pos, CASE WHEN rx LIKE 'AA%' THEN 'AAAA' ELSE rx END)
   SELECT coalesce(a.least, b.least) AS least, a.n AS left_reads, b.n AS right_reads FROM a FULL JOIN b ON a.least = b.least WHERE a.l IS DISTINCT FROM b.l""",
)
def _(spark, d):
    rows = reads(spark, d)
    return order.compare_molecules(rows.withColumn("mi", F.concat_ws(":", "tid", "pos", "rx")), rows.withColumn("mi", F.concat_ws(":", "pos", "tid", F.when(F.startswith("rx", F.lit("AA")), "AAAA").otherwise(F.col("rx")))))


@query(
    "compare_metrics",
    """, a AS (SELECT library, avg(mapq) AS m, count(*) AS n FROM reads GROUP BY library) SELECT library, 'n' AS "column", CAST(n AS DOUBLE) AS "left", CAST(n + 1 AS DOUBLE) AS "right" FROM a WHERE library <> 'lib0'""",
)
def _(spark, d):
    a = reads(spark, d).groupBy("library").agg(F.avg("mapq").alias("m"), F.count("*").alias("n"))
    return order.compare_metrics(a, a.withColumn("n", F.when(F.col("library") != "lib0", F.col("n") + 1).otherwise(F.col("n"))).withColumn("m", F.col("m") + 1e-9), ["library"])


@query("interval_overlap", """ SELECT qname FROM reads r WHERE EXISTS (SELECT 1 FROM (VALUES (0, 5, 20), (2, 0, 9), (3, 13, 14)) AS i(tid, f, t) WHERE r.tid = i.tid AND r.pos + 1 <= i.t AND i.f < r.pos + 6)""")
def _(spark, d):
    rows = reads(spark, d).select("qname", "tid", (F.col("pos") + 1).alias("start"), (F.col("pos") + 6).alias("end"))
    intervals = spark.createDataFrame([(0, 5, 20), (2, 0, 9), (3, 13, 14)], "tid int, `from` long, `to` long")
    return order.overlapping(rows, intervals, width=8).select("qname")


@query(
    "review",
    """, v(tid, site, ref) AS (VALUES (1, 8, 'A'), (2, 4, 'C'), (3, 11, 'G')), g AS (SELECT tid, pos, rx, concat(pos, ':', rx) AS mi, qname, seq FROM reads),
   c AS (SELECT tid, pos, mi, min(seq) AS seq FROM g GROUP BY ALL),
   k AS (SELECT v.site, c.tid, v.ref, c.mi, concat('c', c.mi) AS consensus_read, substr(c.seq, CAST(v.site - c.pos + 1 AS INT), 1) AS consensus_call FROM c JOIN v ON c.tid = v.tid AND v.site - c.pos BETWEEN 0 AND 5),
   r AS (SELECT DISTINCT v.site, g.tid, g.mi, g.qname, substr(g.seq, CAST(v.site - g.pos + 1 AS INT), 1) AS base FROM g JOIN v ON g.tid = v.tid AND v.site - g.pos BETWEEN 0 AND 5)
   SELECT k.*, count(*) FILTER (base = 'A') AS raw_a, count(*) FILTER (base = 'C') AS raw_c, count(*) FILTER (base = 'G') AS raw_g, count(*) FILTER (base = 'T') AS raw_t, count(*) FILTER (base = 'N') AS raw_n
   FROM k LEFT JOIN r ON k.site = r.site AND k.tid = r.tid AND k.mi = r.mi WHERE consensus_call <> ref GROUP BY ALL""",
)
def _(spark, d):
    grouped = reads(spark, d).select("tid", "pos", F.concat("pos", F.lit(":"), "rx").alias("mi"), "qname", "seq")
    con = grouped.groupBy("tid", "pos", "mi").agg(F.min("seq").alias("seq")).withColumn("qname", F.concat(F.lit("c"), "mi"))
    variants = spark.createDataFrame([(1, 8, "A"), (2, 4, "C"), (3, 11, "G")], "tid int, site long, ref string")
    return order.review(con, grouped, variants)


@query(
    "mate_info",
    """, e AS (SELECT *, CASE WHEN line = 7 THEN tid + 1 ELSE tid END AS tid2, CASE WHEN reverse THEN pos + 5 ELSE pos END AS x, CASE WHEN mate_reverse THEN mate_pos + 5 ELSE mate_pos END AS y FROM reads)
   SELECT qname, 1 AS segment, tid2 AS mate_tid, mate_pos, mate_reverse, mate_mapq AS mq, CAST(CASE WHEN tid = tid2 THEN y - x + CASE WHEN y >= x THEN 1 ELSE -1 END ELSE 0 END AS BIGINT) AS tlen FROM e
   UNION ALL SELECT qname, 2, tid, pos, reverse, mapq, CAST(CASE WHEN tid = tid2 THEN x - y + CASE WHEN x >= y THEN 1 ELSE -1 END ELSE 0 END AS BIGINT) FROM e""",
)
def _(spark, d):
    rows = reads(spark, d)
    one = rows.select("qname", F.lit(1).alias("segment"), "tid", "pos", "reverse", "mapq")
    two = rows.select("qname", F.lit(2).alias("segment"), F.when(F.col("line") == 7, F.col("tid") + 1).otherwise(F.col("tid")).alias("tid"), F.col("mate_pos").alias("pos"), F.col("mate_reverse").alias("reverse"), F.col("mate_mapq").alias("mapq"))
    out = order.mate_info(one.union(two).withColumn("end", F.col("pos") + 5))
    return out.select("qname", "segment", "mate_tid", "mate_pos", "mate_reverse", "mq", "tlen")


@query("fastq_records", f""", f AS (SELECT *, {_FLAG} AS flag FROM reads) SELECT qname, concat('@', qname, '+', rx, CASE WHEN line % 2 = 0 THEN '/1' ELSE '/2' END, chr(10), CASE WHEN reverse THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, chr(10), '+', chr(10), 'BBBBBB') AS line FROM f WHERE line < 6""")
def _(spark, d):
    rows = reads(spark, d).withColumn("flag", F.expr(_FLAG).cast("int")).withColumn("qual", F.lit(None).cast("string"))
    return order.to_fastq(rows, umi="rx")


@query("clip_overlap", """, p AS (SELECT qname, pos + 1 AS s1, pos + 20 AS e1, pos + 1 + line AS s2, pos + 20 + line AS e2 FROM reads), m AS (SELECT *, (s1 + e2) // 2 AS m0 FROM p), k AS (SELECT *, CASE WHEN m0 > e1 THEN e1 WHEN m0 < s2 THEN s2 - 1 ELSE m0 END AS mid FROM m)
   SELECT qname, CAST(greatest(e1 - mid, 0) AS BIGINT) AS clip1, CAST(greatest(mid + 1 - s2, 0) AS BIGINT) AS clip2 FROM k""")
def _(spark, d):
    p = reads(spark, d).selectExpr("qname", "pos + 1 AS s1", "pos + 20 AS e1", "pos + 1 + line AS s2", "pos + 20 + line AS e2")
    c = overlap_midpoint(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return p.select("qname", c["clip1"].alias("clip1"), c["clip2"].alias("clip2"))


@query("phred_table", f", t AS ({_tables_sql(PRE, POST)}) SELECT i AS q, round(CASE WHEN i = 0 THEN -99 ELSE ln_right[i + 1] END, 9) AS ln_right, round(ln_wrong[i + 1], 9) AS ln_wrong, single[i + 1] AS single FROM range(94) AS r(i), t")
def _(spark, d):
    right, wrong = phred.right_and_wrong(POST)
    q = F.col("id").cast("int")
    ln_right = F.when(q == 0, F.lit(-99.0)).otherwise(phred.looked_up(right, q))  # of a quality of 0 the formula has next to nothing left of 1
    return spark.range(94).select(F.col("id").alias("q"), F.round(ln_right, 9).alias("ln_right"), F.round(phred.looked_up(wrong, q), 9).alias("ln_wrong"), phred.looked_up(phred.single_read(PRE, POST), q).alias("single"))
