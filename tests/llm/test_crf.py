import zlib

import numpy as np

from molframe.llm import crf

DIR = "/root/testdata/sf0.01"


def test_marginals_equal_brute_force():
    r = np.random.default_rng(0)
    own = crf.Tagger(["a", "b", "c"])
    own.trans, own.start = r.normal(0, 1.5, (3, 3)), r.normal(0, 1, 3)
    sizes = np.array([1, 5, 64, 65, 200, 3])
    e = r.normal(0, 2, (sizes.sum(), 3))
    got, at = own.marginals(e, sizes), 0
    for n in sizes:
        x = e[at : at + n]
        alpha, beta = np.zeros((n, 3)), np.zeros((n, 3))
        alpha[0] = own.start + x[0]
        for t in range(1, n):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + own.trans, axis=0) + x[t]
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(own.trans + (x[t + 1] + beta[t + 1])[None], axis=1)
        p = alpha + beta
        p = np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])
        assert np.allclose(got[at : at + n], p)
        at += n


def test_gradient_of_chain():
    r = np.random.default_rng(1)
    own = crf.Tagger(["a", "b"])
    own.trans, own.start = r.normal(0, 1, (2, 2)), r.normal(0, 1, 2)
    e = r.normal(0, 1, (1, 4, 2))

    def log_z(trans):
        a = own.start + e[0, 0]
        for t in range(1, 4):
            a = np.logaddexp.reduce(a[:, None] + trans, axis=0) + e[0, t]
        return np.logaddexp.reduce(a)

    _, pairs = own._expected(e)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert abs((log_z(own.trans + d) - log_z(own.trans - d)) / 2e-5 - pairs[i, j]) < 1e-6


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = crf.op2_langid(spark, DIR).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    tagger = crf.train_tagger(docs)
    en, fr = "the and of with this that is the was", "le la les des que dans pour une est"
    _, _, parts = crf.Reader(tagger).read([f"{en} {fr}"])
    best = [tagger.labels[i] for i in parts[0][1].argmax(1)]
    assert best[:8] == ["en"] * 8 and best[-8:] == ["fr"] * 8
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 -- ²", 0), (None, "the and of " * 9000, 0), (5, "x" * 50000, 0)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in crf.tag_languages(odd, tagger).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[None].lang_pred == "en" and rows[None].n_words == 27000
    assert crf.tag_languages(odd.limit(0), tagger).count() == 0
    nothing = crf.train_tagger(docs.limit(0))
    assert {r.lang_pred for r in crf.tag_languages(odd, nothing).collect()} == {"und"}
