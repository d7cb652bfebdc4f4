"""Known answers and properties of the parts."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from molframe.functions import align, dna, phred, structure
from molframe.functions.namehash import name_hash, name_hashes
from molframe.operators import clip, cluster, consensus, dedup, order
from molframe.operators.metrics import binomial_both


def test_name_hash_vectors(spark):
    known = {"q0": -593808727, "q2": -974105965, "q3": -1135430185, "q9": 98042550, "read0": 916970908, "read5": -1573193749}
    assert dict(zip(known, name_hashes(list(known)).tolist(), strict=True)) == known
    df = spark.createDataFrame([(k,) for k in known], "n string")
    assert {r.n: r.h for r in df.select("n", name_hash("n").alias("h")).collect()} == known


def value(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


def test_umis(spark):
    rows = [("ACGT", 4, False), ("acgt", 4, False), ("ACGT-TGCA", 8, False), ("ACNT", 3, True), ("acnt", 3, False)]
    for umi, n, has in rows:
        assert value(spark, dna.called_bases(F.col("u")), u=umi) == n and value(spark, dna.has_no_call(F.col("u")), u=umi) is has
    for mi, base in [("123", "123"), ("123/A", "123"), ("abc/456/A", "abc/456"), ("123/C", "123"), ("/A", "/A")]:
        assert value(spark, dna.molecule_base(F.col("m")), m=mi) == base
    assert value(spark, dna.reverse_complement(F.col("s")), s="ACGTNu") == "aNACGT"


def test_structure():
    assert [(s.kind, s.length, s.offset) for s in structure.parse("5M5S+T")] == [("M", 5, 0), ("S", 5, 5), ("T", None, 10)]
    assert structure.parse("+T4M")[1] == structure.Segment("M", 4, -4)
    for bad in ("", "M", "0T", "+T+M", "5Q", "5M x"):
        with pytest.raises(ValueError):
            structure.parse(bad)


def test_phred():
    assert phred.to_phred(-50) == 93 and phred.to_phred(0) == 2
    import math

    assert math.exp(phred.two_trials(math.log(0.1), math.log(0.1))) == pytest.approx(0.2 - 4 / 3 * 0.01)
    assert phred.two_trials(-1, -8) == -1


def test_tie_is_no_call(spark):
    df = spark.createDataFrame([("f", "A", [20]), ("f", "C", [20]), ("g", "A", [20]), ("g", "A", [30])], "fam string, seq string, qual array<int>")
    got = {r.fam: r for r in consensus.consensus_positions(df, ["fam"]).collect()}
    assert (got["f"].base, got["f"].qual, got["f"].depth) == ("N", 2, 2) and got["g"].base == "A" and got["g"].qual > 30 and got["g"].errors == 0


def test_consensus_ignores_read_order(spark):
    r = random.Random(6)
    rows = [("f%d" % (i % 9), "".join(r.choice("ACGTN") for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows = [(f, s, [r.randint(2, 40) for _ in s]) for f, s in rows]
    shape = "fam string, seq string, qual array<int>"
    one = sorted(map(repr, consensus.simplex(spark.createDataFrame(rows, shape), ["fam"], min_reads=2).collect()))
    r.shuffle(rows)
    assert one == sorted(map(repr, consensus.simplex(spark.createDataFrame(rows, shape).repartition(5), ["fam"], min_reads=2).collect()))


@pytest.mark.parametrize("strategy", ["adjacency", "edit", "paired"])
def test_local_clusters_equal_fixpoint(spark, strategy):
    r = random.Random(3)
    umi = (lambda: f"{''.join(r.choice('ACG') for _ in range(3))}-{''.join(r.choice('ACG') for _ in range(3))}") if strategy == "paired" else (lambda: "".join(r.choice("ACG") for _ in range(5)))
    rows = [(g, u) for g in range(3) for u in [umi() for _ in range(25)] for _ in range(r.choice([1, 1, 2, 5, 20]))]
    df = spark.createDataFrame(rows, "g int, umi string")
    if strategy == "paired":
        df = df.withColumn("umi", dna.canonical(F.col("umi")))
    pick = lambda x: sorted((t.g, t.umi, t.n, t.root) for t in x.collect())
    assert pick(cluster.cluster(df, ["g"], strategy=strategy)) == pick(cluster.cluster(df, ["g"], strategy=strategy, local=0))


def test_cluster_scenarios(spark):
    def molecules(counts):
        df = spark.createDataFrame([(0, u) for u, n in counts.items() for _ in range(n)], "g int, umi string")
        return {t.umi: t.root for t in cluster.cluster(df, ["g"]).collect()}

    got = molecules({"AAAAAAAA": 50, "AAAAAAAC": 5, "TTTTTTTT": 30})
    assert got["AAAAAAAC"] == "AAAAAAAA" and len(set(got.values())) == 2
    assert len(set(molecules({"GGGGGGGG": 30, "GGGGGGGC": 20}).values())) == 2
    assert len(set(molecules({"AAAA": 1, "AAAC": 1}).values())) == 1  # 1 div 2 + 1 = 1
    assert len(set(molecules({"AAAA": 3, "AAAC": 2}).values())) == 1


def test_library_size():
    assert dedup.library_size(100, 100) is None and dedup.library_size(0, 0) is None
    x = dedup.library_size(1_000_000, 800_000)
    import math

    assert abs(800_000 / x - 1 + math.exp(-1_000_000 / x)) < 1e-5
    assert binomial_both(2, 1, 1) == 0.5 and binomial_both(1, 1, 1) == 0


def test_clip_start_and_end():
    ops = [("S", 2), ("M", 4), ("I", 3), ("M", 2), ("D", 5), ("M", 6)]
    seq, qual = "N" * 17, list(range(17))
    assert clip.clip_start(10, ops, seq, qual, 4)[:2] == (14, [("H", 6), ("I", 3), ("M", 2), ("D", 5), ("M", 6)])
    pos, got, text, quals, cut = clip.clip_start(10, ops, seq, qual, 5)
    assert (pos, got, cut) == (14, [("H", 9), ("M", 2), ("D", 5), ("M", 6)], 7) and quals == qual[9:] and len(text) == 8
    assert clip.clip_start(10, ops, seq, qual, 9, clip.SOFT)[:2] == (21, [("S", 11), ("M", 6)])
    assert clip.clip_start(10, ops, seq, qual, 15)[0] == -1
    assert clip.clip_end(10, ops, seq, qual, 6)[:2] == (10, [("S", 2), ("M", 4), ("I", 3), ("M", 2), ("H", 6)])
    masked = clip.clip_start(0, [("M", 4)], "ACGT", [9] * 4, 2, clip.MASK)
    assert masked[2:4] == ("NNGT", [2, 2, 9, 9])
    assert clip.upgrade(0, [("H", 1), ("S", 2), ("M", 2), ("S", 1)], "ACGTA", [1, 2, 3, 4, 5]) == (0, [("H", 3), ("M", 2), ("H", 1)], "GT", [3, 4])


def test_cigar_and_names(spark):
    assert value(spark, align.five_prime(F.lit(100), align.cigar(F.col("c")), F.lit(False)), c="2H3S10M") == 95
    assert value(spark, align.five_prime(F.lit(100), align.cigar(F.col("c")), F.lit(True)), c="3S10M2D4M1S2H") == 118
    names = ["a1", "a01", "a2", "a10", "b", "a1b2", "a1b10", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(align.natural_key(F.col("n"))).collect()]
    assert got.index("a2") < got.index("a10") and got.index("a1") < got.index("a01") < got.index("a2") and got[-1] == "b" and got.index("a1b2") < got.index("a1b10")


def test_sources(spark, tmp_path):
    from molframe.sources import text

    p = tmp_path / "x.fastq"
    p.write_text("@r1/1 extra\nACGT\n+\n@III\n@r2/1\nGG\n+r2\n!@\n@r3\nTTT\n+\nABC\n")
    rows = {r.qname: r for r in text.read_fastq(spark, str(p)).collect()}
    assert set(rows) == {"r1", "r2", "r3"} and rows["r1"].qual == "@III" and rows["r2"].qual == "!@" and rows["r3"].seq == "TTT"
    p = tmp_path / "x.sam"
    lines = ["@HD\tVN:1.6", "@RG\tID:A\tLB:lib", "q1\t99\tchr1\t100\t60\t2S3M\t=\t200\t50\tACGTA\tIIIII\tRX:Z:AC\tcD:i:3", "q2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII"]
    p.write_text("\n".join(lines) + "\n")
    sam = text.read_sam(spark, str(p))
    a = {r.qname: r for r in sam.collect()}
    assert a["q1"].pos == 99 and a["q1"].tags == {"RX": "AC", "cD": "3"} and a["q2"].pos == -1 and len(a["q1"].ops) == 2
    text.write_sam(sam, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines[2:])
    assert text.read_groups(spark, str(p)).first() == ("A", "lib")
    p = tmp_path / "x.bed"
    p.write_text("#c\nchr1\t5\t9\n")
    assert text.read_intervals(spark, str(p)).collect() == [("chr1", 5, 9)]
    p = tmp_path / "x.interval_list"
    p.write_text("@SQ\tSN:chr1\nchr1\t5\t9\t+\tn\n")
    assert text.read_intervals(spark, str(p)).collect() == [("chr1", 4, 9)]
    p = tmp_path / "x.vcf"
    p.write_text("##f\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchr1\t10\t.\tA\tC\t.\tPASS\t.\tGT:AD\t0|1:99,1\nchr1\t11\t.\tA\tC\t.\tPASS\t.\tGT:AF\t0/1:0.5\nchr1\t12\t.\tAT\tC\t.\tPASS\t.\tGT\t0/1\nchr1\t13\t.\tG\tT\t.\tq\t.\tGT\t1/1\n")
    assert [(r.site, r.genotype, r.filters) for r in text.read_variants(spark, str(p)).orderBy("site").collect()] == [(9, "A|C", "PASS"), (12, "T/T", "q")]
    p = tmp_path / "x.fa"
    p.write_text(">c1 first\nACG\nT\n>c2\nNN\n")
    assert sorted(map(tuple, text.read_reference(spark, str(p)).collect())) == [("c1", 0, "A"), ("c1", 1, "C"), ("c1", 2, "G"), ("c1", 3, "T"), ("c2", 0, "N"), ("c2", 1, "N")]
    assert text.read_umi_list([" acgt", "TTTT", "ACGT"]) == ["ACGT", "TTTT"]


def test_bam(spark, tmp_path):
    from molframe.sources import bam

    body = b"q1\0" + struct.pack("<2I", 2 << 4 | 4, 3 << 4) + bytes([0x12, 0x48, 0x10]) + bytes([30, 31, 32, 33, 34]) + b"RXZAC\0cDi" + struct.pack("<i", 3) + b"cdBS" + struct.pack("<I2H", 2, 7, 8)
    record = struct.pack("<iiBBHHHiiii", 0, 99, 3, 60, 0, 2, 99, 5, 0, 199, 50) + body
    head = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    (tmp_path / "x.bam").write_bytes(bam.block(head) + bam.block(struct.pack("<i", len(record)) + record) + bam.block(b""))
    r = bam.read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.seq, r.qual, r.tags) == ("q1", 99, "chr1", 99, "ACGTA", [30, 31, 32, 33, 34], {"RX": "AC", "cD": "3", "cd": "7,8"})
    assert [(o.op, o.len) for o in r.ops] == [("S", 2), ("M", 3)]
    bad = bytearray(bam.block(b"some bytes"))
    bad[-6] ^= 1
    with pytest.raises(ValueError):
        list(bam.blocks(bytes(bad)))


def test_stream_equals_batch(spark, tmp_path):
    from molframe.streaming.rates import duplicate_rates

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/event[s].parquet")
    q = duplicate_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    try:
        q.processAllAvailable()
        got = sorted((r.start, r.events) for r in spark.table("rates").collect())
    finally:
        q.stop()
    assert got == sorted((r.start, r.events) for r in duplicate_rates(batch).collect())


def test_orders_and_offsets(spark):
    assert order.quality_offset(spark.createDataFrame([("!!II",)], "qual string")) == 33
    assert order.quality_offset(spark.createDataFrame([("hhhh",)], "qual string")) == 64
    with pytest.raises(ValueError):
        order.quality_offset(spark.createDataFrame([("\x1f",)], "qual string"))
    assert value(spark, order.minor_allele(F.lit(None).cast("double"), F.col("a")), a=[90, 10]) == pytest.approx(0.1)
