"""Steps that must not grow faster than their input: what larger tables found."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molframe import catalog
from molframe.operators import clip, cluster, consensus, filters, metrics, numbering, order

DIR = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixpoint_blocks(spark):
    """Labels cross blocks of three ranks; and no table of nodes is broadcast, however small its file is."""
    rng = random.Random(5)
    for strategy in ("adjacency", "edit", "paired"):
        umis = [(g, "-".join("".join(rng.choice("AC" if strategy == "edit" else "ACG") for _ in range(3)) for _ in range(1 + (strategy == "paired")))) for g in range(3) for _ in range(60)]
        df = spark.createDataFrame(umis, "g int, umi string")
        pick = lambda x: sorted((r.g, r.umi, r.n, r.root) for r in x.collect())
        far = cluster.cluster(df, ["g"], strategy=strategy, local=0, block=3)
        assert pick(far) == pick(cluster.cluster(df, ["g"], strategy=strategy))
        assert "BroadcastHashJoin" not in physical(far)


def test_fixpoint_chain(spark):
    """A chain through all blocks and back, so that labels go from block to block."""
    chain = ["AAAAAAAA"]
    for i in range(8):
        chain.append(chain[-1][:i] + "C" + chain[-1][i + 1 :])
    rng = random.Random(1)
    rng.shuffle(chain)
    df = spark.createDataFrame([(1, u) for u in chain], "g int, umi string")
    rows = cluster.cluster(df, ["g"], strategy="edit", local=0, block=2).collect()
    assert len(rows) == 9 and {r.root for r in rows} == {"AAAAAAAA"}


def test_codec_far_apart(spark):
    """Reads that don't meet are dropped before their fragment is built; nulls are dropped; the others are combined."""
    rows = [("far", 0, "ACGT", [30] * 4, 2**40, "ACGT", [30] * 4), ("near", 5, "ACGN", [30, 30, 40, 2], 6, "CTGA", [20, 41, 30, 9]), ("null", 1, None, None, 1, "A", [9])]
    pairs = spark.createDataFrame(rows, "q string, pos1 long, seq1 string, qual1 array<int>, pos2 long, seq2 string, qual2 array<int>")
    got = [tuple(r) for r in consensus.codec(pairs, ["q"], outer=1, outer_qual=7, single_qual=25).collect()]
    assert got == [("near", "ACNNA", [7, 50, 2, 2, 7], 3, 1)]


def test_overlap_odd_rows(spark):
    rows = [("x", 3, "ACG", [9, 9, 9], 4, "CT", [9, 8]), ("null", None, "AC", [5, 6], 1, "GG", [7, 8]), ("none", 1, "", [], 1, "A", [4]), ("short", 1, "AA", [9], 1, "AA", [9, 9])]
    pairs = spark.createDataFrame(rows, "q string, pos1 long, seq1 string, qual1 array<int>, pos2 long, seq2 string, qual2 array<int>")
    got = {r.q: (r.seq1, r.qual1, r.seq2, r.qual2) for r in consensus.call_overlaps(pairs, ["q"]).collect()}
    assert got == {"x": ("ACG", [9, 18, 2], "CG", [18, 2]), "null": ("AC", [5, 6], "GG", [7, 8]), "none": ("", [], "A", [4]), "short": ("AA", [18, None], "AA", [18, 9])}


@pytest.mark.parametrize("name", ["codec_consensus", "overlap_consensus", "overlap_mask_lower", "consensus_positions", "simplex_consensus", "umi_consensus"])
def test_no_lambda_for_each_base(spark, name):
    """Lambdas of Catalyst are interpreted, base by base."""
    assert "lambda" not in catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["consensus_positions", "simplex_consensus", "duplex_consensus", "umi_consensus"])
def test_a_family_moves_once(spark, name):
    """Neither positions nor qualities are rows that are sorted or listed: they spilled."""
    plan = physical(catalog.queries()[name](spark, DIR))
    assert "collect_list" not in plan and "Generate" not in plan
    assert plan.count("Exchange hashpartitioning") == (2 if name == "umi_consensus" else 1)


def test_families_across_batches(spark):
    """Families longer than an Arrow batch are called whole."""
    rng = random.Random(2)
    rows = [("f%d" % (i % 4), rng.choice("AB"), s, [rng.randint(2, 40) for _ in s], s[:3].ljust(3, "A")) for i in range(90) for s in ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 9)))]]
    df = spark.createDataFrame([*rows, (None, "A", "ACG", [30, 30, 30], None)], "fam string, strand string, seq string, qual array<int>, rx string").coalesce(1)
    run = lambda: [sorted(map(repr, x.collect())) for x in (consensus.simplex(df, ["fam"], min_reads=3), consensus.consensus_positions(df, ["fam"]), consensus.duplex(df, ["fam"], min_reads=(2, 1, 0)), consensus.umi_consensus(df, ["fam"]))]
    one = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run() == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_observed_umis(spark):
    """Case, nulls, unlike lengths and reads without a molecule count as they did by joins; reads and consensuses are not joined."""
    rows = [("1", "acg"), ("1", "ACG"), ("1", "ACT"), ("2", None), ("2", "AC"), ("3", None), (None, "GG"), ("4", "AC"), ("4", "ACG"), ("5", "ACG"), ("5", "NCG")]
    df = spark.createDataFrame([(1, f"q{i}", m, u) for i, (m, u) in enumerate(rows)], "pos int, qname string, mi string, rx string")
    counts = metrics.simplex_metrics(df, ["pos"])["umi_counts"]
    got = {r.umi: (r.raw_observations, r.raw_observations_with_errors, r.unique_observations) for r in counts.collect()}
    assert got == {"ACG": (5, 3, 2), "AC": (4, 1, 2), None: (2, 0, 1)}
    assert "Join" not in physical(counts)


def test_duplex_halves_are_not_joined(spark):
    assert "Join" not in physical(catalog.queries()["duplex_metrics_umis"](spark, DIR))


def test_clip_once_for_a_shape(spark):
    """Pairs of one shape are clipped alike, wherever they lie: surgery runs once for each."""
    ops = lambda text: [(x[-1], int(x[:-1])) for x in re.findall("[0-9]+[A-Z]", text)]
    rng = random.Random(4)
    rows = []
    for i in range(60):
        size = lambda c: sum(n for op, n in ops(c) if op in "MIS")
        c1, c2 = rng.choice(["2S8M", "4M1I5M", "10M"]), rng.choice([None, "9M", "3M2D6M1S", "1H6M3S"])
        p1, p2 = rng.choice([(-1, 7), (0, 3), (500, 497), (500, 504), (2**33, 2**33 + 2)])
        one = lambda c: ("".join(rng.choice("ACGT") for _ in range(size(c))), [rng.randint(2, 40) for _ in range(size(c))]) if c else (None, None)
        rows.append((f"q{i}", p1, ops(c1), *one(c1), False, p2, ops(c2) if c2 else None, *one(c2), True))
    side = lambda i: f"pos{i} long, cigar{i} array<struct<op string, len int>>, seq{i} string, qual{i} array<int>, reverse{i} boolean"
    df = spark.createDataFrame(rows, f"qname string, {side(1)}, {side(2)}")
    for mode in (clip.SOFT, clip.MASK, clip.HARD):
        options = {"mode": mode, "fixed": (1, 0, 2, 1), "overlap": True, "beyond_mate": True, "upgrading": mode == clip.HARD}
        whole = sorted(map(repr, clip.clip_pairs(df, **options).collect()))
        assert len(whole) == 60
        if mode == clip.MASK:
            assert whole == sorted(map(repr, clip.clip_pairs(df.repartition(60, "qname"), **options).collect()))
    batch = pa.RecordBatch.from_pylist([{"pos1": p, "cigar1": [{"op": "M", "len": 3}], "seq1": "ACG", "qual1": [1, 2, 3], "reverse1": False, "pos2": p + 1, "cigar2": [{"op": "M", "len": 3}], "seq2": "ACG", "qual2": [1, 2, 3], "reverse2": True} for p in range(500)])
    keys, kind, shift = clip._shapes(batch)
    assert len(keys) == 1 and set(kind) == {0} and list(shift) == list(range(500))


@pytest.mark.parametrize("mapped", [None, "mapped"])
def test_majority_moves_reads_once(spark, monkeypatch, mapped):
    """In batches and by counts (deep families) the same reads stay, and reads aren't joined."""
    rng = random.Random(3)
    cigars = ["6M", "3M1I2M", "2M1D4M", "2S4M", "3M1I1M", "4M", "3M2I1M", "6=", ""]
    rows = [(rng.randrange(12) or None, f"q{i}", [(x[-1], int(x[:-1])) for x in re.findall("[0-9]+[A-Z=]", rng.choice(cigars))], "ACGTAC"[: rng.randint(3, 6)], rng.random() < 0.8) for i in range(150)]
    df = spark.createDataFrame(rows, "fam int, qname string, ops array<struct<op string, len int>>, seq string, mapped boolean").filter("fam IS NOT NULL")
    names = lambda x: sorted(r.qname for r in x.collect())
    found = consensus.majority_alignment(df, ["fam"], mapped=mapped)
    assert "Join" not in physical(found)
    monkeypatch.setattr(consensus, "DEEP", 0)
    assert names(found) == names(consensus.majority_alignment(df, ["fam"], mapped=mapped))


def test_mask_duplex_without_lambdas(spark):
    df = spark.createDataFrame([("ACGN", [30, 5, 30, 2], [2, 2, 0, 2], [0, 0, 0, 0], [2, 2, 2, 2], [0, 0, 2, 0], "ACGT", "ACTT"), ("AC", [30, 30], None, [0], [1], [0], "A", "A")], "seq string, qual array<int>, ad array<int>, ae array<int>, bd array<int>, be array<int>, ac string, bc string")
    out = filters.mask_duplex(df, (1,), (0.5,), 10, agreement=True)
    assert [(r.seq, r.qual, r.newly) for r in out.collect()] == [("ANNN", [30, 2, 2, 2], 2), (None, None, None)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("mate_info", 1), ("full_mate_info", 1), ("zip_names", 2), ("sort_verify", 3)])
def test_reads_move_no_oftener(spark, name, most):
    """Mates meet by name in one exchange; numbered rows are not dealt anew for their numbers."""
    plan = physical(catalog.queries()[name](spark, DIR))
    assert plan.count("Exchange hashpartitioning(") - plan.count("Exchange hashpartitioning(range_") <= most


def test_review_sends_sites_to_reads(spark):
    plan = physical(catalog.queries()["review"](spark, DIR))
    assert "BroadcastHashJoin [tid" in plan and "SortMergeJoin [tid" not in plan


def test_mates_of_odd_names(spark):
    rows = [("a", 1, 0, 10, 15, False, 7), ("a", 2, 0, 30, 35, True, 8), ("b", 1, 0, 1, 6, False, 9), (None, 1, 0, 5, 9, False, 1), (None, 2, 0, 6, 9, True, 2), ("c", 0, 0, 1, 2, False, 3)]
    df = spark.createDataFrame(rows, "qname string, segment int, tid int, pos long, `end` long, reverse boolean, mapq int")
    got = sorted((r.qname or "", r.segment, r.mate_pos, r.mq, r.tlen) for r in order.mate_info(df).collect())
    assert got == [("", 1, None, None, 0), ("", 2, None, None, 0), ("a", 1, 30, 8, 26), ("a", 2, 10, 7, -26), ("b", 1, None, None, 0), ("c", 0, None, None, 0)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.place for r in numbering.numbered(df, ["k"]).collect())


@pytest.mark.parametrize("name", ["group_command", "group_command_paired", "group_command_cut", "group_paired"])
def test_grouping_derives_templates_once(spark, name):
    """Neither the input nor the clusters are computed again for the last join."""
    plan = physical(catalog.queries()[name](spark, DIR))
    assert "lineitem" not in plan and "MapInPandas" not in plan.replace("MapInPandas", "", 1)
    assert name == "group_paired" or "MapInPandas" not in plan


def test_cluster_of_counts(spark):
    rows = [("AAA", 3), ("AAC", 1), ("GGG", 2), ("aaa", 1), (None, 5)]
    df = spark.createDataFrame(rows, "umi string, k int").withColumn("g", F.lit(1))
    pick = lambda x: sorted((r.umi, r.n, r.root) for r in x.collect())
    assert pick(cluster.cluster(df, ["g"], count="k")) == pick(cluster.cluster(df.withColumn("i", F.explode(F.sequence(F.lit(1), "k"))), ["g"])) == [("AAA", 4, "AAA"), ("AAC", 1, "AAA"), ("GGG", 2, "GGG")]
