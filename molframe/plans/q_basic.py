"""Queries on names, UMIs, filters, correction, duplicates and metrics, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from molframe.functions import align, dna
from molframe.functions.structure import parse, pieces
from molframe.operators import dedup, metrics, template
from molframe.operators.numbering import numbered, running_offsets
from molframe.plans.readview import DUCK, reads

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str, view: bool = True):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = (DUCK if view else "") + sql
        return f

    return keep


FIXED = ["AACC", "ACGT", "CATG", "GGTT", "TTAA", "TGCA"]

_REV = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query("reverse_complement", f" SELECT DISTINCT rx, seq, {_REV.format('rx')} AS rx_rc, {_REV.format('seq')} AS seq_rc FROM reads")
def _(spark, d):
    return reads(spark, d).select("rx", "seq", dna.reverse_complement(F.col("rx")).alias("rx_rc"), dna.reverse_complement(F.col("seq")).alias("seq_rc")).distinct()


@query(
    "umi_validation",
    """ SELECT raw_umi, count(*) AS n, coalesce(contains(raw_umi, 'N'), NULL) AS has_n, CAST(length(regexp_replace(raw_umi, '[^ACGTacgt]', '', 'g')) AS BIGINT) AS bases
    FROM reads GROUP BY raw_umi""",
)
def _(spark, d):
    u = F.col("raw_umi")
    return reads(spark, d).groupBy("raw_umi").agg(F.count("*").alias("n")).withColumn("has_n", dna.has_no_call(u)).withColumn("bases", dna.called_bases(u))


@query(
    "umi_distance",
    """, u AS (SELECT DISTINCT rx FROM reads), w(b) AS (VALUES """ + ", ".join(f"('{u}')" for u in FIXED) + """)
    SELECT rx AS a, b, CAST(hamming(rx, b) AS BIGINT) AS packed, CAST(hamming(rx, b) AS BIGINT) AS spelled FROM u, w""",
)
def _(spark, d):
    pairs = reads(spark, d).select(F.col("rx").alias("a")).distinct().select("a", F.explode(F.array(*map(F.lit, FIXED))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", dna.packed_distance(dna.packed(a), dna.packed(b)).cast("long").alias("packed"), dna.distance(a, b).cast("long").alias("spelled"))


_FLAG = "(1 + CASE WHEN reverse THEN 16 ELSE 0 END + CASE WHEN mate_reverse THEN 32 ELSE 0 END + CASE WHEN line % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN line = 7 THEN 2048 WHEN line = 6 THEN 256 ELSE 0 END + CASE WHEN mapq < 3 THEN 4 ELSE 0 END)"


@query(
    "flag_counts",
    f""", f AS (SELECT {_FLAG} AS flag FROM reads)
    SELECT CAST(flag AS INT) AS flag, count(*) AS n, (flag & 4) <> 0 AS unmapped, (flag & 16) <> 0 AS reverse, (flag & 2304) = 0 AS is_primary FROM f GROUP BY flag""",
)
def _(spark, d):
    f = F.col("flag")
    rows = reads(spark, d).select(F.expr(_FLAG).cast("int").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return rows.select("flag", "n", align.has(f, align.UNMAPPED).alias("unmapped"), align.has(f, align.REVERSE).alias("reverse"), align.primary(f).alias("is_primary"))


_CIGAR = "concat(line, 'S', mapq + 10, 'M', line, 'I', mapq, 'M', line + 1, 'D', 5, 'M', 3, 'S', 2, 'H')"


@query(
    "cigar_lengths",
    """ SELECT line, mapq, reverse, CAST(10 + 2 * mapq + line + 1 + 5 AS INT) AS ref_len, CAST(line + mapq + 10 + line + mapq + 5 + 3 AS INT) AS query_len,
       CAST(2 * mapq + 15 + line AS INT) AS aligned, CAST(line + 5 AS INT) AS clipped,
       CAST(CASE WHEN reverse THEN 1000 + 2 * mapq + 16 + line - 1 + 5 ELSE 1000 - line END AS BIGINT) AS five_prime, count(*) AS n
    FROM reads GROUP BY line, mapq, reverse""",
)
def _(spark, d):
    ops = align.cigar(F.expr(_CIGAR))
    rows = reads(spark, d).groupBy("line", "mapq", "reverse").agg(F.count("*").alias("n")).withColumn("ops", ops)
    o = F.col("ops")
    return rows.select("line", "mapq", "reverse", align.reference_length(o).alias("ref_len"), align.query_length(o).alias("query_len"), align.aligned_bases(o).alias("aligned"), align.clipped_bases(o).alias("clipped"), align.five_prime(F.lit(1000), o, F.col("reverse")).cast("long").alias("five_prime"), "n")


@query(
    "pair_orientation",
    """ SELECT CASE WHEN reverse = mate_reverse THEN 'TANDEM' WHEN NOT reverse THEN CASE WHEN pos <= mate_pos + 5 THEN 'FR' ELSE 'RF' END
        ELSE CASE WHEN mate_pos <= pos + 5 THEN 'FR' ELSE 'RF' END END AS orientation, library, count(*) AS n FROM reads GROUP BY 1, 2""",
)
def _(spark, d):
    c = F.col
    o = align.pair_orientation(c("tid"), c("pos"), c("pos") + 5, c("reverse"), c("tid"), c("mate_pos"), c("mate_pos") + 5, c("mate_reverse"))
    return reads(spark, d).groupBy(o.alias("orientation"), "library").agg(F.count("*").alias("n"))


@query("read_structure", """ SELECT qname, substr(seq, 1, 2) AS umi, substr(seq, 3, 1) AS skipped, substr(seq, 4, length(seq) - 4) AS template, substr(seq, length(seq), 1) AS cell FROM reads""")
def _(spark, d):
    segments = parse("2M1S+T1C")
    one = lambda kind, name: pieces(F.col("seq"), segments, kind)[0].alias(name)
    return reads(spark, d).select("qname", one("M", "umi"), one("S", "skipped"), one("T", "template"), one("C", "cell"))


@query(
    "extract_umis",
    """ SELECT qname, concat_ws('-', rx, substr(seq, 1, 3), substr(dual, 1, 2)) AS umi, substr(seq, 4) AS template_1, substr(dual, 3) AS template_2 FROM reads""",
)
def _(spark, d):
    return template.extract(reads(spark, d), {"seq": "3M+T", "dual": "2M+T"}, name_umi=F.col("rx")).select("qname", "umi", "template_1", "template_2")


@query("umi_of_name", f""" SELECT DISTINCT concat('a:b:c:d:e:f:g:', rx, '+r', substr(dual, 1, 2)) AS name, concat(rx, '-', {_REV.format("substr(dual, 1, 2)")}) AS umi FROM reads""")
def _(spark, d):
    names = reads(spark, d).select(F.concat(F.lit("a:b:c:d:e:f:g:"), "rx", F.lit("+r"), F.substring("dual", 1, 2)).alias("name")).distinct()
    return names.withColumn("umi", align.umi_of_name(F.col("name")))


@query("plain_names", """ SELECT DISTINCT concat('q', line, '/', 1 + line % 2, ' extra') AS name, concat('q', line) AS plain FROM reads""")
def _(spark, d):
    n = reads(spark, d).select(F.expr("concat('q', line, '/', 1 + line % 2, ' extra')").alias("name")).distinct()
    return n.withColumn("plain", align.plain_name(F.col("name")))


_REASON = """CASE WHEN mapq < 2 THEN 'low_mapq' WHEN mate_mapq < 2 THEN 'low_mate_mapq' WHEN contains(raw_umi, 'N') THEN 'umi_has_n'
     WHEN length(raw_umi) < 4 THEN 'umi_too_short' WHEN raw_umi IS NULL THEN 'umi_missing' END"""


def _filtered(spark, d):
    rows = reads(spark, d)
    return rows.withColumn("reason", template.reject_reason(F.col("raw_umi"), F.col("mapq"), F.col("mate_mapq"), min_mapq=2, min_umi=4, unmapped=F.lit(False)))


@query("template_filter", f" SELECT library, {_REASON} AS reason, count(*) AS n FROM reads GROUP BY 1, 2")
def _(spark, d):
    return _filtered(spark, d).groupBy("library", "reason").agg(F.count("*").alias("n"))


_FAMILIES = ", fam AS (SELECT tid, pos, reverse, mate_reverse, raw_umi, count(*) AS size FROM reads WHERE (" + _REASON + ") IS NULL GROUP BY ALL)"
_KEYS = ["tid", "pos", "reverse", "mate_reverse"]


@query(
    "family_sizes_identity",
    _FAMILIES
    + """, c AS (SELECT size AS family_size, count(*) AS "count" FROM fam GROUP BY size)
    SELECT CAST(family_size AS BIGINT) AS family_size, "count", "count" / sum("count") OVER () AS fraction,
       sum("count") OVER (ORDER BY family_size DESC ROWS UNBOUNDED PRECEDING) / sum("count") OVER () AS fraction_gt_or_eq_family_size FROM c""",
)
def _(spark, d):
    sizes = _filtered(spark, d).filter("reason IS NULL").groupBy(*_KEYS, "raw_umi").agg(F.count("*").alias("size"))
    return metrics.size_distribution(sizes)


@query(
    "position_group_sizes",
    """, g AS (SELECT tid, pos, count(*) AS size FROM reads GROUP BY ALL), c AS (SELECT size AS position_group_size, count(*) AS "count" FROM g GROUP BY size)
    SELECT CAST(position_group_size AS BIGINT) AS position_group_size, "count", "count" / sum("count") OVER () AS fraction,
       sum("count") OVER (ORDER BY position_group_size DESC ROWS UNBOUNDED PRECEDING) / sum("count") OVER () AS fraction_gt_or_eq_position_group_size FROM c""",
)
def _(spark, d):
    return metrics.size_distribution(reads(spark, d).groupBy("tid", "pos").agg(F.count("*").alias("size")), named="position_group_size")


@query(
    "grouping_summary",
    _FAMILIES
    + """, c AS (SELECT size AS s, count(*) AS c FROM fam GROUP BY size), h AS (SELECT *, 2 * sum(c) OVER (ORDER BY s) >= sum(c) OVER () AS half FROM c)
    SELECT CAST(sum(c) AS BIGINT) AS families, CAST(sum(s * c) AS BIGINT) AS reads, sum(s * c) / sum(c) AS mean_size, min(s) FILTER (half) AS median_size, min(s) AS min_size, max(s) AS max_size FROM h""",
)
def _(spark, d):
    return metrics.grouping_summary(_filtered(spark, d).filter("reason IS NULL").groupBy(*_KEYS, "raw_umi").agg(F.count("*").alias("size")))


_LIST = "(VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(sorted(FIXED))) + ") AS w(i, u)"
_MATCH = f""", seg AS (SELECT DISTINCT rx AS segment FROM reads),
   m AS (SELECT segment, u, hamming(segment, u) AS dist, row_number() OVER (PARTITION BY segment ORDER BY hamming(segment, u), i) AS r FROM seg, {_LIST}),
   best AS (SELECT a.segment, a.dist <= 2 AND b.dist - a.dist >= 1 AS matched, a.u AS umi, CAST(a.dist AS INT) AS mismatches, CAST(b.dist AS INT) AS "second"
            FROM m a JOIN m b ON a.segment = b.segment AND a.r = 1 AND b.r = 2)"""


@query("umi_best_match", _MATCH + " SELECT * FROM best")
def _(spark, d):
    return template.best_matches(reads(spark, d).select(F.col("rx").alias("segment")), FIXED)


@query(
    "umi_correction_metrics",
    _MATCH
    + f""", named AS (SELECT CASE WHEN matched THEN umi ELSE 'NNNN' END AS umi, matched, mismatches FROM reads JOIN best ON rx = segment),
   c AS (SELECT w.u AS umi, count(n.umi) AS total_matches, count(*) FILTER (matched AND mismatches = 0) AS perfect_matches, count(*) FILTER (matched AND mismatches = 1) AS one_mismatch_matches,
       count(*) FILTER (matched AND mismatches = 2) AS two_mismatch_matches, count(*) FILTER (matched AND mismatches > 2) AS other_matches
       FROM (SELECT u FROM {_LIST} UNION ALL SELECT 'NNNN') w LEFT JOIN named n ON n.umi = w.u GROUP BY w.u)
   SELECT *, total_matches / sum(total_matches) OVER () AS fraction_of_matches, total_matches / ((sum(total_matches) FILTER (umi <> 'NNNN') OVER ()) / {float(len(FIXED))}::DOUBLE) AS representation FROM c""",
)
def _(spark, d):
    segments = reads(spark, d).select(F.col("rx").alias("segment"))
    return template.correction_metrics(segments, template.best_matches(segments, FIXED), FIXED)


@query(
    "correct_dual_umis",
    """, seg AS (SELECT DISTINCT s FROM (SELECT split_part(dual, '-', 1) AS s FROM reads UNION ALL SELECT split_part(dual, '-', 2) FROM reads)),
   m AS (SELECT s, u, hamming(s, u) AS dist, row_number() OVER (PARTITION BY s ORDER BY hamming(s, u), i) AS r FROM seg, (VALUES (0, 'AC'), (1, 'GG'), (2, 'TA')) AS w(i, u)),
   best AS (SELECT a.s, a.dist <= 1 AND b.dist - a.dist >= 1 AS ok, a.u, a.dist FROM m a JOIN m b ON a.s = b.s AND a.r = 1 AND b.r = 2)
   SELECT dual, CASE WHEN x.ok AND y.ok THEN concat(x.u, '-', y.u) END AS corrected, CASE WHEN x.ok AND y.ok AND x.dist + y.dist > 0 THEN dual END AS original, CAST(x.dist + y.dist AS BIGINT) AS total_mismatches, count(*) AS n
   FROM reads JOIN best x ON x.s = split_part(dual, '-', 1) JOIN best y ON y.s = split_part(dual, '-', 2) GROUP BY ALL""",
)
def _(spark, d):
    out = template.correct_umis(reads(spark, d), ["AC", "GG", "TA"], max_mismatches=1, min_distance=1, umi="dual")
    return out.groupBy("dual", "corrected", "original", "total_mismatches").agg(F.count("*").alias("n"))


_FAMILY = "tid, pos, reverse, mate_reverse, rx, library"
_MARKED = f", marked AS (SELECT *, row_number() OVER (PARTITION BY {_FAMILY} ORDER BY score DESC, qname) > 1 AS duplicate FROM reads)"


def _marked(spark, d):
    return dedup.mark_duplicates(reads(spark, d), _FAMILY.split(", "))


@query("mark_duplicates", _MARKED + " SELECT qname, duplicate FROM marked")
def _(spark, d):
    return _marked(spark, d).select("qname", "duplicate")


@query("mark_duplicates_no_umi", " SELECT qname, row_number() OVER (PARTITION BY tid, pos, reverse, mate_reverse, library ORDER BY score DESC, qname) > 1 AS duplicate FROM reads")
def _(spark, d):
    return dedup.mark_duplicates(reads(spark, d), ["tid", "pos", "reverse", "mate_reverse", "library"]).select("qname", "duplicate")


@query("read_scores", """ SELECT qname, CAST(least(list_sum(list_filter(qual, lambda q: q >= 15)), 16383) - CASE WHEN line = 7 THEN 16384 ELSE 0 END AS INT) AS score FROM reads""")
def _(spark, d):
    return reads(spark, d).select("qname", dedup.read_score(F.col("qual"), F.col("line") == 7).alias("score"))


@query(
    "dedup_metrics",
    _MARKED
    + """ SELECT coalesce(library, 'all') AS library, count(*) AS total_templates, count(*) FILTER (duplicate) AS duplicate_templates, count(*) FILTER (NOT duplicate) AS unique_templates,
    count(*) FILTER (duplicate) / count(*) AS duplicate_rate FROM marked GROUP BY ROLLUP (library)""",
)
def _(spark, d):
    return dedup.dedup_metrics(_marked(spark, d))


@query(
    "duplication_ladder",
    _MARKED
    + """, g AS (SELECT library, tid, pos, reverse, mate_reverse, count(*) AS n, count(*) FILTER (duplicate) AS d FROM marked GROUP BY ALL),
   r AS (SELECT *, sum(n) OVER w AS seen, sum(d) OVER w AS dup, lead(n) OVER w IS NULL AS last FROM g WINDOW w AS (PARTITION BY library ORDER BY tid, pos, reverse, mate_reverse)),
   e AS (SELECT * FROM r WHERE last OR seen // 1000 > (seen - n) // 1000),
   f AS (SELECT library, seen, dup, seen - coalesce(lag(seen) OVER w, 0) AS wt, dup - coalesce(lag(dup) OVER w, 0) AS wd FROM e WINDOW w AS (PARTITION BY library ORDER BY seen))
   SELECT library, CAST(seen AS BIGINT) AS templates_seen, dup / seen AS duplicate_fraction, CAST(wt AS BIGINT) AS window_templates, wd / wt AS window_duplicate_fraction FROM f""",
)
def _(spark, d):
    groups = _marked(spark, d).groupBy("library", *_KEYS).agg(F.count("*").alias("templates"), F.count_if("duplicate").alias("duplicates"))
    return dedup.duplication_ladder(groups, _KEYS, 1000)


def _library_size(spark, d):
    rows = _marked(spark, d).groupBy("library").agg(F.count("*").alias("pairs"), F.count_if(~F.col("duplicate")).alias("unique_pairs"))
    return rows.withColumn("library_size", dedup.library_size_udf("pairs", "unique_pairs"))


QUERIES["library_size"] = _library_size
#: The bisection, step by step.
_ROOT = "(c / x - 1 + exp(-n / x))"
SQL["library_size"] = DUCK + _MARKED + f""", c0 AS (SELECT library, count(*)::DOUBLE AS n, (count(*) FILTER (NOT duplicate))::DOUBLE AS c FROM marked GROUP BY library),
   c1 AS (SELECT *, list_min(list_filter([100e0, 1000e0, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9], lambda h: {_ROOT.replace("x", "(h * c)").replace("e(h * c)p", "exp")} < 0)) AS high FROM c0),
   steps AS (SELECT library, n, c, 1e0 AS low, high, 0 AS i FROM c1 UNION ALL SELECT library, n, c, CASE WHEN f > 0 THEN middle ELSE low END, CASE WHEN f > 0 THEN high ELSE middle END, i + 1
      FROM (SELECT *, (low + high) / 2 AS middle, {_ROOT.replace("x", "((low + high) / 2 * c)").replace("e((low + high) / 2 * c)p", "exp")} AS f FROM steps WHERE i < 40))
   SELECT library, CAST(n AS BIGINT) AS pairs, CAST(c AS BIGINT) AS unique_pairs, CAST(floor(c * ((low + high) / 2)) AS BIGINT) AS library_size FROM steps WHERE i = 40"""


@query(
    "simplex_family_sizes",
    """, cs AS (SELECT count(*) AS s FROM reads GROUP BY tid, pos), ss AS (SELECT count(*) AS s FROM reads GROUP BY tid, pos, rx),
   c AS (SELECT coalesce(a.s, b.s) AS family_size, coalesce(a.n, 0) AS cs_count, coalesce(b.n, 0) AS ss_count FROM (SELECT s, count(*) AS n FROM cs GROUP BY s) a FULL JOIN (SELECT s, count(*) AS n FROM ss GROUP BY s) b ON a.s = b.s)
   SELECT *, cs_count / sum(cs_count) OVER () AS cs_fraction, sum(cs_count) OVER w / sum(cs_count) OVER () AS cs_fraction_gt_or_eq_size,
      ss_count / sum(ss_count) OVER () AS ss_fraction, sum(ss_count) OVER w / sum(ss_count) OVER () AS ss_fraction_gt_or_eq_size FROM c WINDOW w AS (ORDER BY family_size DESC ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    size = lambda *k: reads(spark, d).groupBy(*k).agg(F.count("*").alias("size"))
    return metrics.size_distributions({"cs": size("tid", "pos"), "ss": size("tid", "pos", "rx")})


@query(
    "duplex_family_sizes",
    """, cs AS (SELECT count(*) AS s FROM reads GROUP BY tid, pos), ss AS (SELECT count(*) AS s FROM reads GROUP BY tid, pos, rx, reverse), ds AS (SELECT count(*) AS s FROM reads GROUP BY tid, pos, rx),
   k AS (SELECT s, 1 AS a, 0 AS b, 0 AS c FROM cs UNION ALL SELECT s, 0, 1, 0 FROM ss UNION ALL SELECT s, 0, 0, 1 FROM ds),
   c AS (SELECT s AS family_size, CAST(sum(a) AS BIGINT) AS cs_count, CAST(sum(b) AS BIGINT) AS ss_count, CAST(sum(c) AS BIGINT) AS ds_count FROM k GROUP BY s)
   SELECT *, cs_count / sum(cs_count) OVER () AS cs_fraction, sum(cs_count) OVER w / sum(cs_count) OVER () AS cs_fraction_gt_or_eq_size,
      ss_count / sum(ss_count) OVER () AS ss_fraction, sum(ss_count) OVER w / sum(ss_count) OVER () AS ss_fraction_gt_or_eq_size,
      ds_count / sum(ds_count) OVER () AS ds_fraction, sum(ds_count) OVER w / sum(ds_count) OVER () AS ds_fraction_gt_or_eq_size FROM c WINDOW w AS (ORDER BY family_size DESC ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    size = lambda *k: reads(spark, d).groupBy(*k).agg(F.count("*").alias("size"))
    return metrics.size_distributions({"cs": size("tid", "pos"), "ss": size("tid", "pos", "rx", "reverse"), "ds": size("tid", "pos", "rx")})


_STRANDS = ", st AS (SELECT tid, pos, rx, count(*) FILTER (reverse) AS a, count(*) FILTER (NOT reverse) AS b FROM reads GROUP BY tid, pos, rx)"


def _strands(spark, d):
    return metrics.strand_sizes(reads(spark, d).withColumn("strand", F.when(F.col("reverse"), "A").otherwise("B")), ["tid", "pos", "rx"])


@query(
    "duplex_strand_sizes",
    _STRANDS
    + """, c AS (SELECT greatest(a, b) AS ab_size, least(a, b) AS ba_size, count(*) AS "count" FROM st GROUP BY 1, 2)
   SELECT c.ab_size, c.ba_size, c."count", c."count" / (SELECT sum("count") FROM c) AS fraction, sum(o."count") / (SELECT sum("count") FROM c) AS fraction_gt_or_eq_size
   FROM c JOIN c o ON o.ab_size >= c.ab_size AND o.ba_size >= c.ba_size GROUP BY c.ab_size, c.ba_size, c."count" """,
)
def _(spark, d):
    return metrics.dominance(_strands(spark, d))


@query(
    "umi_counts",
    """, r AS (SELECT *, min(raw_umi) OVER (PARTITION BY tid, pos, rx) AS consensus FROM reads WHERE raw_umi IS NOT NULL),
   c AS (SELECT consensus AS umi, count(*) AS raw_observations, count(*) FILTER (raw_umi <> consensus) AS raw_observations_with_errors, count(DISTINCT (tid, pos, rx)) AS unique_observations FROM r GROUP BY consensus)
   SELECT *, raw_observations / sum(raw_observations) OVER () AS fraction_raw_observations, unique_observations / sum(unique_observations) OVER () AS fraction_unique_observations FROM c""",
)
def _(spark, d):
    rows = reads(spark, d).filter("raw_umi IS NOT NULL").withColumn("consensus", F.min("raw_umi").over(Window.partitionBy("tid", "pos", "rx")))
    return metrics.umi_counts(rows, "raw_umi", "consensus", ["tid", "pos", "rx"])


@query(
    "duplex_umi_counts",
    """, one AS (SELECT u AS umi, count(DISTINCT (tid, pos, rx)) AS n FROM (SELECT tid, pos, rx, split_part(dual, '-', 1) AS u FROM reads UNION ALL SELECT tid, pos, rx, split_part(dual, '-', 2) FROM reads) GROUP BY u),
   f AS (SELECT umi, n / sum(n) OVER () AS f FROM one),
   c AS (SELECT dual AS umi, count(*) AS raw_observations, 0::BIGINT AS raw_observations_with_errors, count(DISTINCT (tid, pos, rx)) AS unique_observations FROM reads GROUP BY dual)
   SELECT c.*, raw_observations / sum(raw_observations) OVER () AS fraction_raw_observations, unique_observations / sum(unique_observations) OVER () AS fraction_unique_observations, x.f * y.f AS fraction_unique_observations_expected
   FROM c JOIN f x ON x.umi = split_part(c.umi, '-', 1) JOIN f y ON y.umi = split_part(c.umi, '-', 2)""",
)
def _(spark, d):
    rows = reads(spark, d)
    halves = rows.select("tid", "pos", "rx", F.explode(F.split("dual", "-")).alias("u"))
    key = ["tid", "pos", "rx"]
    return metrics.expected_dual(metrics.umi_counts(rows, "dual", "dual", key), metrics.umi_counts(halves, "u", "u", key))


@query("molecule_offsets", """, g AS (SELECT tid, pos, count(DISTINCT rx) AS molecules FROM reads GROUP BY tid, pos) SELECT *, CAST(coalesce(sum(molecules) OVER (ORDER BY tid, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g""")
def _(spark, d):
    groups = reads(spark, d).groupBy("tid", "pos").agg(F.count_distinct("rx").alias("molecules"))
    return running_offsets(groups, ["tid", "pos"], "molecules")


@query("downsample", """, r AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', tid, pos, rx, '42')), 1, 8) AS BIGINT) AS h FROM reads) SELECT tid, pos, rx, count(*) AS size FROM r WHERE h < 1288490188 GROUP BY ALL""")
def _(spark, d):
    return template.downsample(reads(spark, d), ["tid", "pos", "rx"], 0.3).groupBy("tid", "pos", "rx").agg(F.count("*").alias("size"))


@query(
    "zipper",
    f""", u AS (SELECT qname, line AS segment, raw_umi AS umi, rx FROM reads), m AS (SELECT qname, line AS segment, pos, reverse FROM reads WHERE mapq > 10)
   SELECT u.qname, u.segment, m.pos, m.reverse, u.umi, CASE WHEN coalesce(m.reverse, false) THEN {_REV.format("u.rx")} ELSE u.rx END AS rx, m.qname IS NULL AS missing FROM u LEFT JOIN m ON u.qname = m.qname AND u.segment = m.segment""",
)
def _(spark, d):
    rows = reads(spark, d)
    unmapped = rows.select("qname", F.col("line").alias("segment"), F.col("raw_umi").alias("umi"), "rx")
    mapped = rows.filter("mapq > 10").select("qname", F.col("line").alias("segment"), "pos", "reverse")
    return template.zipper(unmapped, mapped, ["umi", "rx"], revcomp=("rx",))


@query("zip_names", """ SELECT row_number() OVER (ORDER BY qname) AS ord, qname, seq AS left_seq, dual AS right_seq FROM reads""")
def _(spark, d):
    rows = numbered(reads(spark, d).select("qname", "seq", "dual"), ["qname"]).withColumn("ord", F.col("place") + 1)
    both = template.zip_names(rows.select("ord", "qname", "seq"), rows.select("ord", "qname", "dual"))
    return both.select("ord", "qname", F.col("r1.seq").alias("left_seq"), F.col("r2.dual").alias("right_seq"))


def _tagged(spark, d):
    return reads(spark, d).select("qname", F.map_filter(F.create_map(F.lit("RX"), F.col("raw_umi"), F.lit("QX"), F.when(F.col("line") < 4, F.col("rg")), F.lit("MI"), F.col("rx")), lambda k, v: v.isNotNull()).alias("tags"))


@query(
    "retag",
    """ SELECT qname, CASE WHEN raw_umi IS NOT NULL THEN raw_umi END AS ox, CASE WHEN line < 4 THEN rg ELSE rx END AS mi, NULL::VARCHAR AS qx FROM reads""",
)
def _(spark, d):
    out, _rows = template.retag(_tagged(spark, d), ["RX::copy::OX", "QX::move::MI", "ZZ::delete"])
    return out.select("qname", F.try_element_at("tags", F.lit("OX")).alias("ox"), F.try_element_at("tags", F.lit("MI")).alias("mi"), F.try_element_at("tags", F.lit("QX")).alias("qx"))


@query(
    "retag_counters",
    """ SELECT 'RX::copy::OX' AS operation, count(raw_umi) AS records_applied, 0::BIGINT AS dst_overwritten, count(*) - count(raw_umi) AS src_missing FROM reads
   UNION ALL SELECT 'QX::move::MI', count(*) FILTER (line < 4 AND rg IS NOT NULL), count(*) FILTER (line < 4 AND rg IS NOT NULL), count(*) FILTER (NOT (line < 4 AND rg IS NOT NULL)) FROM reads
   UNION ALL SELECT 'ZZ::delete', 0, 0, count(*) FROM reads""",
)
def _(spark, d):
    return template.retag(_tagged(spark, d), ["RX::copy::OX", "QX::move::MI", "ZZ::delete"])[1]
