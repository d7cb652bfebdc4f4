"""Faults that came back once, and the whole commands on built cases."""

import random

import pytest
from pyspark.sql import functions as F

from molframe.functions.align import flag_order
from molframe.operators import cluster, consensus, group, metrics, order, template
from molframe.session import shared_dir
from molframe.sources.text import read_fastq


def test_overlapping_keeps_equal_reads(spark):
    reads = spark.createDataFrame([(1, 5, 9, "r")] * 3 + [(1, 50, 60, "s"), (2, 5, 9, "t")], "tid int, start long, end long, name string")
    intervals = spark.createDataFrame([(1, 0, 6), (1, 4, 2000)], "tid int, from long, to long")
    assert [r.name for r in order.overlapping(reads, intervals).orderBy("name").collect()] == ["r", "r", "r", "s"]


def test_breaks_across_gaps_of_ordinals(spark):
    rows = [(0, 0, 5, False, "a"), (1, 0, 7, False, "b"), (1_000_000, 0, 6, False, "c"), (5_000_000, 0, 9, False, "d")]
    df = spark.createDataFrame(rows, "ord long, tid int, pos long, reverse boolean, qname string")
    assert [r.qname for r in order.out_of_order(df, "coordinate", parts=10).collect()] == ["c"]


def test_flags_of_both_ends_sort_last(spark):
    flags = [0xC1, 0x81 | 0x100, 0x81 | 0x800, 0x81, 0x41 | 0x100, 0x41 | 0x800, 0x41, 0]
    df = spark.createDataFrame([(f,) for f in flags], "flag int").orderBy(flag_order(F.col("flag")))
    assert [r.flag for r in df.collect()] == flags[::-1]


def test_zip_fails_on_stray_mapped_records(spark):
    unmapped = spark.createDataFrame([("a", 1, "AC")], "qname string, segment int, rx string")
    mapped = spark.createDataFrame([("a", 1, 5, False), ("b", 1, 6, False)], "qname string, segment int, pos int, reverse boolean")
    assert template.zipper(unmapped, mapped.filter("qname = 'a'"), ["rx"]).count() == 1
    for exclude in (True, False):
        with pytest.raises(Exception, match="mapped without an unmapped record"):
            template.zipper(unmapped, mapped, ["rx"], exclude_missing=exclude).collect()


def test_zip_of_three(spark):
    one = lambda names: spark.createDataFrame(list(enumerate(names)), "ord long, qname string")
    got = template.zip_many([one("ab"), one("ab"), one("ab")]).collect()
    assert sorted((r.ord, r.qname, r.r1.qname, r.r3.qname) for r in got) == [(0, "a", "a", "a"), (1, "b", "b", "b")]
    for other in ("ac", "a", "abc"):
        with pytest.raises(Exception, match="differ"):
            template.zip_many([one("ab"), one("ab"), one(other)]).collect()


def test_fastq_by_lines(spark, tmp_path):
    r = random.Random(4)
    want = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 30, 80])))) for i in range(3000)]
    text = "".join(f"@{n} x\n{s}\n+\n{'@' * len(s)}\n" for n, s in want)
    (tmp_path / "a.fastq").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "10000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_fastq(spark, str(tmp_path / "a.fastq"))
            rows = sorted((x.ord, x.qname, x.seq, x.qual) for x in got.collect())
            assert rows == [(i, n, s, "@" * len(s)) for i, (n, s) in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "b.fastq").write_text("@r\nA\n+\n")
    (tmp_path / "c.fastq").write_text("r\nA\n+\nI\n")
    for bad in ("b", "c"):
        with pytest.raises(Exception, match="multiple of four|no FASTQ record"):
            read_fastq(spark, str(tmp_path / f"{bad}.fastq")).collect()


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, other: None)

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)


def test_umis_that_cannot_be_clustered(spark):
    rows = [(1, u) for u in ["ACGT", "ACGT", "ACGA", "NCGT", "ncgt", "TTTT", "AANN"]]
    got = cluster.number_molecules(cluster.cluster(spark.createDataFrame(rows, "g int, umi string"), ["g"]), ["g"], "adjacency")
    assert {r.umi: r.mi for r in got.collect()} == {"ACGT": 0, "ACGA": 0, "TTTT": 1, "NCGT": 3, "AANN": 2}
    for local in (4000, 0):
        with pytest.raises(Exception, match="differ in length"):
            cluster.cluster(spark.createDataFrame([(1, "ACG"), (1, "ACGT")], "g int, umi string"), ["g"], local=local).collect()
    assert cluster.cluster(spark.createDataFrame([(1, "ACG"), (2, "ACGT"), (1, "ANNNN")], "g int, umi string"), ["g"]).count() == 3


def brute_labels(umis, counts, strategy, k):
    """Least rank that reaches each UMI, by search from every one."""
    flip = lambda u: "-".join(reversed(u.split("-")))
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    near = lambda a, b: min(apart(a, b), apart(a, flip(b)) if strategy == "paired" else 99) <= k
    label = [-1] * len(umis)
    for root in range(len(umis)):
        front = [root] if label[root] < 0 else []
        while front:
            i = front.pop()
            label[i] = root
            front += [j for j in range(len(umis)) if label[j] < 0 and near(umis[i], umis[j]) and (strategy == "edit" or counts[j] <= counts[i] // 2 + 1)]
    return label


@pytest.mark.parametrize("strategy", ["adjacency", "edit", "paired"])
def test_labels_against_brute_force(strategy):
    r = random.Random(5)
    for _ in range(60):
        half = lambda: "".join(r.choice("AC") for _ in range(3))
        umis = list({f"{min(a, b)}-{max(a, b)}" if strategy == "paired" else a + b for a, b in ((half(), half()) for _ in range(r.randint(1, 30)))})
        both = sorted(((r.choice([1, 1, 2, 3, 9]), u) for u in umis), key=lambda x: (-x[0], x[1]))
        counts, umis = [n for n, _ in both], [u for _, u in both]
        k = r.randint(0, 2)
        assert cluster.local_labels(umis, counts, strategy, k).tolist() == brute_labels(umis, counts, strategy, k)


def test_group_errors(spark):
    shape = "tid int, qname string, umi string, r1_forward boolean, r2_forward boolean, r1_earlier boolean"
    one = lambda umi: spark.createDataFrame([(1, "a", umi, True, None, True)], shape)
    for umi, options, match in ((None, {}, "missing UMI"), ("ACGT", {"strategy": "paired"}, "two halves"), ("AC", {"min_umi_length": 3}, "shorter")):
        with pytest.raises(Exception, match=match):
            group.group(one(umi), ["tid"], **options).collect()
    with pytest.raises(ValueError):
        group.group(one("AC-GT"), ["tid"], "paired", min_umi_length=2)
    rows = [(1, "a", "AC-GT", True, True, True), (1, "b", "GT-AC", True, True, False), (1, "c", "GT-AC", True, True, True)]
    got = {r.qname: r.mi for r in group.group(spark.createDataFrame(rows, shape), ["tid"], "paired").collect()}
    assert got == {"a": "0/A", "b": "0/B", "c": "1/A"}
    assert {r.mi for r in group.group(spark.createDataFrame(rows, shape), ["tid"], no_umi=True).collect()} == {"0"}


def _shape(ops, n):
    kinds, out = [("M" if k in "SH=X" else k, m) for k, m in ops], []
    for k, m in kinds:
        out = [*out[:-1], (k, out[-1][1] + m)] if out and out[-1][0] == k else [*out, (k, m)]
    cut = []
    for k, m in out:
        if n <= 0:
            break
        take = min(m, n) if k in "MI" else m
        n -= take if k in "MI" else 0
        cut.append((k, take))
    return cut


def _majority(reads):
    groups = []
    for i, (ops, n) in sorted(enumerate(reads), key=lambda x: -x[1][1]):
        s, found = _shape(ops, n), False
        for first, members in groups:
            same = len(s) <= len(first) and all(a == b if j < len(s) - 1 else a[0] == b[0] and a[1] <= b[1] for j, (a, b) in enumerate(zip(s, first, strict=False)))
            if same:
                members.append(i)
                found = True
        if not found:
            groups.append((s, [i]))
    best = min(groups, key=lambda g: (-len(g[1]), [(m, "MIDNSHP=X".index(k)) for k, m in g[0]]))
    return set(best[1])


def test_majority_alignment_against_brute_force(spark):
    r = random.Random(9)
    rows, want = [], {}
    choices = [[("M", 10)], [("S", 2), ("M", 8)], [("M", 4), ("I", 1), ("M", 5)], [("M", 4), ("D", 2), ("M", 6)], [("H", 3), ("M", 10)]]
    for f in range(40):
        reads = [(r.choice(choices), r.choice([5, 8, 10])) for _ in range(r.randint(1, 9))]
        want[f] = _majority(reads)
        rows += [(f, i, "A" * n, [(k, m) for k, m in ops]) for i, (ops, n) in enumerate(reads)]
    df = spark.createDataFrame(rows, "f int, i int, seq string, ops array<struct<op:string,len:int>>")
    got = {}
    for x in consensus.majority_alignment(df, ["f"]).collect():
        got.setdefault(x.f, set()).add(x.i)
    assert got == want


def test_trim_turn_and_segments(spark):
    df = spark.createDataFrame([("AACC", [30, 30, 2, 2], False), ("AACC", [2, 30, 30, 30], True), ("AC", [1, 1], False), ("A", [40], False)], "seq string, qual array<int>, reverse boolean")
    assert [(r.seq, r.qual) for r in consensus.trimmed(consensus.turned(df), 20).collect()] == [("AA", [30, 30]), ("GGT", [30, 30, 30]), ("", []), ("A", [40])]
    rows = [("x", 1, "AC", [30, 30]), ("x", 2, "GG", [30, 30]), ("y", 1, "AC", [30, 30]), ("z", 0, "TT", [30, 30])]
    got = consensus.by_segment(spark.createDataFrame(rows, "mi string, segment int, seq string, qual array<int>"), ["mi"]).collect()
    assert sorted((r.mi, r.segment, r.seq) for r in got) == [("x", 1, "AC"), ("x", 2, "GG"), ("z", 0, "TT")]
    assert consensus.name_prefix(["b", "a", "b"]) == "a|b" and len(consensus.name_prefix([str(i) * 9 for i in range(99)])) == 32


def test_deep_families_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    rows = [("f%d" % (i % 5), r.choice("AB"), s, [r.randint(2, 40) for _ in s]) for i in range(80) for s in ["".join(r.choice("ACGTN") for _ in range(r.randint(1, 9)))]]
    df = spark.createDataFrame(rows, "fam string, strand string, seq string, qual array<int>")
    run = lambda: (sorted(map(repr, consensus.simplex(df, ["fam"], min_reads=2).collect())), sorted(map(repr, consensus.duplex(df, ["fam"]).collect())))
    one = run()
    monkeypatch.setattr(consensus, "DEEP", 15)
    assert run() == one


def test_metrics_refuse_both_strands_and_consensus(spark):
    df = spark.createDataFrame([(1, "q", "1/A", "AC"), (1, "r", "1/B", "AC")], "pos int, qname string, mi string, rx string")
    with pytest.raises(ValueError, match="both strands"):
        metrics.simplex_metrics(df, ["pos"])
    rows = spark.createDataFrame([(True, True, True, None), (True, False, True, None)], "paired boolean, r1_mapped boolean, r2_mapped boolean, cD int")
    assert metrics.eligible(rows, "cD").count() == 1
    with pytest.raises(Exception, match="consensus reads"):
        metrics.eligible(rows.withColumn("cD", F.lit(3)), "cD").collect()


def test_downsample_rejects(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(200)], "mi int, i int")
    kept, rejected, sizes = template.downsample_with_rejects(df, ["mi"], 0.5)
    assert kept.count() + rejected.count() == 200 and kept.join(rejected, "mi").count() == 0
    assert sum(r["count"] * r.family_size for r in sizes.collect()) == 200
    with pytest.raises(ValueError):
        template.downsample(df, ["mi"], 0)
