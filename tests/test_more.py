"""Clips, mates, comparison, review, files, simulation and streams on built cases."""

import random

import pytest
from pyspark.sql import functions as F

from molframe.functions.align import cigar, read_position
from molframe.operators import clip, consensus, order
from molframe.sources import bam, simulate
from molframe.sources.text import read_metrics, write_metrics
from molframe.streaming import running


def test_read_position_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for _ in range(120):
        ops = [(r.choice("MIDNSH=X"), r.randint(1, 4)) for _ in range(r.randint(1, 6))]
        q, ref, at = 0, 10, {}
        for op, n in ops:
            for _ in range(n):
                if op in "M=X":
                    at[ref] = q
                if op in "DN":
                    at[ref] = -1
                q, ref = q + (op in "MIS=X"), ref + (op in "MDN=X")
        rows += [("".join(f"{n}{op}" for op, n in ops), p, at.get(p)) for p in range(9, 34)]
    df = spark.createDataFrame(rows, "cigar string, p long, want long")
    out = df.withColumn("got", read_position(F.lit(10), cigar(F.col("cigar")), F.col("p")))
    assert out.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_clipping_metrics_of_fragments(spark):
    ops = [("S", 2), ("M", 8)]
    rows = [("f", 5, ops, "A" * 10, [30] * 10, False, None, None, None, None, None), ("p", 5, ops, "A" * 10, [30] * 10, False, 7, [("M", 10)], "C" * 10, [30] * 10, True)]
    shape = "qname string, " + ", ".join(f"pos{i} long, cigar{i} array<struct<op:string,len:int>>, seq{i} string, qual{i} array<int>, reverse{i} boolean" for i in (1, 2))
    got = {r.read_type: r for r in clip.clipping_metrics(clip.clip_pairs(spark.createDataFrame(rows, shape), fixed=(1, 0, 0, 3))).collect()}
    assert {k: (r.reads, r.reads_clipped_pre, r.bases_clipped_five_prime, r.bases_clipped_three_prime, r.bases_clipped_post) for k, r in got.items()} == {
        "Fragment": (1, 1, 1, 0, 3), "ReadOne": (1, 1, 1, 0, 3), "ReadTwo": (1, 0, 0, 3, 3), "Pair": (2, 1, 1, 3, 6), "All": (3, 2, 2, 3, 9),
    }


def test_tags_cut_with_their_read(spark):
    df = spark.createDataFrame([("ACGTAC", "ACG")], "t string, other string")
    cut = lambda c, start: clip.clipped_tag(F.col(c), F.lit(6), F.lit(4), F.lit(start))
    assert tuple(df.select(cut("t", True), cut("t", False), cut("other", True)).first()) == ("GTAC", "ACGT", "ACG")


def test_duplex_pairs(spark):
    shape = "mi string, strand string, segment int, reverse boolean, seq string, qual array<int>"
    one = lambda mi, s, k, rev, seq: (mi, s, k, rev, seq, [30] * len(seq))
    rows = [one("x", "A", 1, False, "ACGT"), one("x", "B", 2, False, "ACGA"), one("x", "A", 2, True, "GGCC"), one("x", "B", 1, True, "GGCC")]
    rows += [one("y", "A", 1, False, "ACGT"), one("y", "B", 2, True, "ACGT"), one("z", "A", 1, False, "AC"), one("z", "B", 2, False, "AC")]
    got, rejected = consensus.duplex_pairs(spark.createDataFrame(rows, shape), ["mi"])
    assert sorted((r.mi, r.segment, r.seq, r.a_depth, r.b_least, r.c_depth) for r in got.collect()) == [("x", 1, "ACGN", 1, 1, 2), ("x", 2, "GGCC", 1, 1, 2)]
    assert sorted(map(tuple, rejected.collect())) == [("y", "potential_collision"), ("z", "orphan_consensus")]
    umis = spark.createDataFrame([("x", "A", "AC-GT"), ("x", "B", "GT-AC")], "mi string, strand string, rx string")
    assert consensus.molecule_rx(umis, ["mi"]).first().umi == "AC-GT"


def test_comparisons(spark):
    shape = "qname string, flag int, tags map<string,string>, ord long"
    a = spark.createDataFrame([("r", 1, {"RX": "A", "mi": "1", "tc": "x"}, 0), ("s", 1, {"RX": "C"}, 1)], shape)
    b = spark.createDataFrame([("r", 1, {"mi": "2", "RX": "A"}, 1), ("s", 1, {"RX": "G"}, 0)], shape)
    assert sorted(r.qname for r in order.compare_reads(a, b, "exact").drop("ord").collect()) == ["r", "s"]
    drop = lambda df: df.drop("ord")
    assert [r.qname for r in order.compare_reads(drop(a), drop(b), "group").collect()] == ["s"]
    assert order.compare_reads(a, b, "group", ordinal="ord").count() == 2 and order.compare_reads(a, a, ordinal="ord").count() == 0
    assert order.compare_headers(["@HD\tVN:1.6\tSO:x", "@PG\tID:a", "@SQ\tSN:c\tLN:5"], ["@HD\tSO:x\tVN:1.6", "@SQ\tSN:c\tLN:6"]) == [("left", "@SQ\tLN:5\tSN:c"), ("right", "@SQ\tLN:6\tSN:c")]
    one = spark.createDataFrame([("a", "1/A"), ("b", "1/B"), ("c", "2/A"), ("d", "2/A")], "qname string, mi string")
    two = spark.createDataFrame([("a", "7/B"), ("b", "7/A"), ("c", "8/A"), ("d", "8/B")], "qname string, mi string")
    assert [r.least for r in order.strand_partition(one, two).collect()] == ["c"]


def test_full_review(spark):
    shape = "qname string, mi string, tid int, pos long, cigar string, seq string"
    con = spark.createDataFrame([("c1", "1", 0, 10, "6M", "AACAAA"), ("c2", "2", 0, 10, "2M1D3M", "AAAAA"), ("c3", "3", 0, 10, "6M", "AANAAA"), ("c4", "4", 0, 10, "6M", "AAAAAA")], shape).withColumn("ops", cigar(F.col("cigar")))
    raw = spark.createDataFrame([("r1", "1/A", 0, 10, "6M", "AACAAA"), ("r1", "1/A", 0, 10, "6M", "AACAAA"), ("r2", "1/B", 0, 10, "6M", "AAGAAA"), ("r3", "4", 0, 10, "6M", "AACAAA")], shape).withColumn("ops", cigar(F.col("cigar")))
    sites = spark.createDataFrame([(0, 12, "A")], "tid int, site long, ref string")
    calls, reads = order.full_review(con, raw, sites)
    got = {r.consensus_read: r for r in calls.collect()}
    assert {k: r.consensus_call for k, r in got.items()} == {"c1": "C", "c2": "*", "c3": "N"}
    assert (got["c1"].raw_c, got["c1"].raw_g, got["c1"].consensus_a, got["c1"].consensus_del) == (1, 1, 1, 1) and got["c2"].raw_c is None
    assert {r.qname for r in reads.collect()} == {"r1", "r2"}
    assert order.full_review(con, raw, sites, ignore_ns=True)[0].count() == 2


def test_bam_there_and_back(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for i in range(500):
        n = r.randint(0, 40)
        ops = [("S", 1), ("M", n - 1)] if n > 2 else [("M", n)] if n else []
        rows.append((f"q{i}", r.choice([0, 16, 77]), "b" if i % 3 else None, 100 + i, 30, ops, 0, 7, -4, "".join(r.choice("ACGTN") for _ in range(n)), [r.randint(2, 40) for _ in range(n)] if i % 5 else None, {"RX": "ACGT", "cD": str(i)}, {"cD": "i"}))
    shape = "qname string, flag int, rname string, pos long, mapq int, ops array<struct<op:string,len:int>>, mate_tid int, mate_pos long, tlen long, seq string, qual array<int>, tags map<string,string>, tag_types map<string,string>"
    df = spark.createDataFrame(rows, shape).repartitionByRange(3, "pos").sortWithinPartitions("pos")
    bam.write_bam(df, str(tmp_path / "x.bam"), {"a": 1000, "b": 5000}, bam.header_text("@HD\tVN:1.6\n", {"ID": "m", "CL": "y"}))
    got = bam.read_bam(spark, str(tmp_path / "x.bam")).collect()
    assert [g.qname for g in got] == [x[0] for x in rows]
    for g, x in zip(got, rows, strict=True):
        assert (g.flag, g.rname, g.pos, g.mapq, [(o.op, o.len) for o in g.ops], g.mate_pos, g.tlen, g.seq, g.tags) == (x[1], x[2], x[3], 30, x[5], 7, -4, x[9], x[11])
        assert g.qual == (x[10] if x[9] and x[10] is not None else None if x[9] else [])
    assert bam.detect_format(spark, str(tmp_path / "x.bam")) == "bam"
    assert (bam.bin_of(0, 1), bam.bin_of(1 << 14, (1 << 14) + 1), bam.bin_of(0, 1 << 15)) == (4681, 4682, 585)


def test_formats_and_headers():
    kinds = {b"@r\nA\n": "fastq", b"@SQ\tSN:a\n": "sam", b">c\nA": "fasta", b"##fileformat=VCFv4.2\n": "vcf", b"chr1\t1\t2\n": "text", b"\x1f\x8b\x08": "gzip"}
    assert {k: bam.format_of(k) for k in kinds} == kinds
    text = bam.header_text("", {"ID": "m", "PN": "m"})
    assert bam.header_text(text, {"ID": "m"}).split("\n")[1] == "@PG\tID:m.1\tPP:m"


def test_metrics_files(spark, tmp_path):
    write_metrics(spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "k string, n long, f double").coalesce(1), str(tmp_path / "m"))
    assert sorted(map(tuple, read_metrics(spark, str(tmp_path / "m")).collect())) == [("a", 1, 0.5), ("b", 2, 0.25)]


def test_simulations(spark):
    mapped = simulate.mapped_reads(spark, 300)
    pairs = mapped.filter("segment = 1").alias("a").join(mapped.filter("segment = 2").alias("b"), "qname")
    assert pairs.count() * 2 == mapped.count() and pairs.filter("a.pos <> b.mate_pos OR b.pos <> a.mate_pos OR a.reverse <> b.mate_reverse OR (NOT a.unmapped AND a.reverse = b.reverse)").count() == 0
    assert 0 < mapped.filter("unmapped").count() < 0.1 * mapped.count()
    con = simulate.consensus_reads(spark, 300)
    assert con.filter("cM > cD OR size(depths) <> length(seq) OR cE > 0.2").count() == 0
    fixed = ["AAAACCCC", "GGGGTTTT"]
    umis = simulate.correct_reads(spark, 3000, fixed).collect()
    assert all(sum(a != b for a, b in zip(r.rx, r.true_umi, strict=True)) == r.changed and r.true_umi in fixed for r in umis)
    assert 0.85 < sum(r.changed == 0 for r in umis) / len(umis) < 0.95
    n = spark.range(4000).select(simulate.negative_binomial_size(1, F.col("id"), 4.0, 2).alias("nb"), simulate.empirical_size(2, F.col("id"), {1: 3, 5: 1}).alias("e"), simulate.strand_bias(3, F.col("id")).alias("b"), simulate.insert_size(4, F.col("id")).alias("i"))
    m = n.agg(F.avg("nb"), F.variance("nb"), F.avg(F.col("e") == 5 if False else (F.col("e") == 5).cast("int")), F.avg("b"), F.avg("i")).first()
    assert m[0] == pytest.approx(4, abs=0.2) and m[1] == pytest.approx(3 + 9 / 2, abs=1.2) and m[2] == pytest.approx(0.25, abs=0.03) and m[3] == pytest.approx(0.5, abs=0.02) and m[4] == pytest.approx(300, abs=5)


def test_streams_with_state(spark, tmp_path):
    shape = "library string, templates long, duplicates long"
    for i, rows in enumerate([[("x", 40, 4), ("y", 10, 1)], [("x", 70, 7)], [("x", 95, 9), ("y", 95, 2)]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = running.running_ladder(stream, 100).writeStream.format("memory").queryName("ladder").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.library, r.templates_seen) for r in spark.table("ladder").collect()) in ([("x", 110), ("x", 205), ("y", 105)], [("x", 135), ("x", 205), ("y", 105)], [("x", 110), ("x", 205), ("y", 105)])
    seen = {}
    number = running.Numbering(str(tmp_path / "numbers"), lambda b: b.withColumn("molecule", F.monotonically_increasing_id()), lambda rows, k: seen.__setitem__(k, sorted(r.molecule for r in rows.collect())))
    for k, n in enumerate((3, 0, 4)):
        number(spark.range(n).coalesce(1).toDF("id"), k)
    number(spark.range(4).coalesce(1).toDF("id"), 2)  # run again
    assert seen == {0: [0, 1, 2], 1: [], 2: [3, 4, 5, 6]}
    one = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, qname string")
    assert running.zip_streams([one, one]).count() == 2
    with pytest.raises(Exception, match="differ"):
        running.zip_streams([one, one.withColumn("qname", F.lit("z"))]).collect()


def test_modified_bases(spark):
    from molframe.operators.tags import modified_bases

    r = random.Random(8)
    rows = []
    for _ in range(60):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(0, 30)))
        rows.append((seq, [r.random() < 0.4 for _ in seq], [r.randrange(256) for _ in seq]))
    for x in spark.createDataFrame(rows, "seq string, m array<boolean>, p array<int>").select("*", modified_bases(F.col("seq"), F.col("m"), F.col("p")).alias("t")).collect():
        at = [i for i, b in enumerate(x.seq) if b == "C"]
        hits = [k for k, i in enumerate(at) if x.m[i]]
        if not hits:
            assert x.t is None
        else:
            assert x.t.mm == "C+m," + ",".join(str(k - p - 1) for p, k in zip([-1, *hits], hits, strict=False)) + ";" and x.t.ml == [x.p[at[k]] for k in hits]


def test_reference_pieces(spark, tmp_path):
    from molframe.sources.text import read_reference, read_reference_pieces, reference_at, reference_lengths

    r = random.Random(5)
    contigs = {"a": "".join(r.choice("ACGT") for _ in range(257)), "b": "".join(r.choice("ACGT") for _ in range(40))}
    (tmp_path / "r.fa").write_text("".join(f">{k} x\n" + "\n".join(v[i : i + 60].lower() for i in range(0, len(v), 60)) + "\n" for k, v in contigs.items()))
    path = str(tmp_path / "r.fa")
    assert {x.chrom: x.length for x in reference_lengths(spark, path).collect()} == {k: len(v) for k, v in contigs.items()}
    assert sorted((x.chrom, x.ref_pos, x.ref) for x in read_reference(spark, path).collect()) == [(k, i, b) for k, v in contigs.items() for i, b in enumerate(v)]
    reads = [(k, p, n) for k, v in contigs.items() for p in range(0, len(v), 7) for n in (0, 1, 33) if p + n <= len(v)]
    got = reference_at(spark.createDataFrame(reads, "chrom string, pos long, length int"), read_reference_pieces(spark, path, 16), size=16)
    assert all(x.ref == contigs[x.chrom][x.pos : x.pos + x.length] for x in got.collect()) and got.count() == len(reads)
