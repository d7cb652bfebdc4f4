import zlib

import numpy as np

from molframe.llm import quality as q

DIR = "/root/testdata/sf0.01"


def test_pooling_equals_brute_force():
    net = q.Network()
    docs = [b"", b"a", b"ab" * 100, bytes(range(256)) * 3, b"x" * 256, b"y" * 257, b"The end. " * 700]
    got = net.pooled(docs)
    w = net.filters.reshape(q.WIDTH * q.CODE, q.FILTERS)
    for d, value in zip(docs, got, strict=True):
        halves = max(1, -(-len(d) // q.HALF))
        x = net.code[np.frombuffer(d.ljust(halves * q.HALF + q.STRIDE, b"\0"), np.uint8)]
        acts = np.stack([x[i : i + q.WIDTH].reshape(-1) @ w for i in range(0, halves * q.HALF, q.STRIDE)])
        chunks = [acts[c * q.STEPS : (c + 2) * q.STEPS].max(0) for c in range(max(1, halves - 1))]
        assert np.allclose(value, np.mean([np.maximum(c + net.bias, 0) for c in chunks], 0), atol=1e-3)


def test_blocks_do_not_matter(monkeypatch):
    docs = [b"some words " * n for n in (1, 900, 40, 3000, 7)]
    want = q.Network().score(docs)
    monkeypatch.setattr(q, "BLOCK", 4096)
    assert np.allclose(q.Network().score(docs), want)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = q.op10_quality(spark, DIR).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([a for a, b in held if b == 1]) > 0.95 and np.mean([a for a, b in held if b == 0]) < 0.4


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, "", 6.0), (None, "the " * 40000, 7.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = q.score_quality(df, q.train_quality(df, labels), keep=("text",)).collect()
    assert len(rows) == 3 and len({r.score for r in rows if not r.text}) == 1
    assert {r.score for r in q.score_quality(df, q.train_quality(df, labels.limit(0))).collect()} == {0.5}
    assert q.score_quality(df.limit(0), None).count() == 0
