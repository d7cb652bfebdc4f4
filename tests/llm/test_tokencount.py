import random

import public_tokenizers as P

from molframe.llm import tokencount as tc
from molframe.llm.bpe import RANKS, codec


def brute(word, scores, longest):
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        best[d] = min(((-(-best[s][0] + scores[word[s:d]]), best[s][1] + 1) for s in range(max(0, d - longest), d) if word[s:d] in scores), key=lambda x: (x[0], x[1]))
    return best[-1][1]


def test_counts_equal_brute_force():
    scores = tc.unigram_scores(codec(P.path(RANKS), P.PATTERN).ranks)
    longest = max(map(len, scores))
    r = random.Random(4)
    words = {"", "the", " the", "there", "a" * 300, "é" * 40} | {"".join(r.choice("abcdeth éßино漢") for _ in range(r.randint(1, 25))) for _ in range(400)}
    words = [w.encode() for w in words]
    own = tc.Counter(scores)
    want = [brute(w, scores, longest) for w in words]
    assert own.counts(words).tolist() == want
    assert [own.chain(w) for w in words if w] == [n for w, n in zip(words, want, strict=True) if w]


def test_long_pretokens(monkeypatch):
    scores = tc.unigram_scores(codec(P.path(RANKS), P.PATTERN).ranks)
    own, r = tc.Counter(scores), random.Random(6)
    words = ["".join(r.choice("abcdeth") for _ in range(3000)).encode(), b"a" * 2500]
    monkeypatch.setattr(tc, "STARTS", 700)
    assert own.counts(words).tolist() == [brute(w, scores, max(map(len, scores))) for w in words]


def test_query_against_brute_force(spark):
    own = codec(P.path(RANKS), P.PATTERN)
    scores = tc.unigram_scores(own.ranks)
    longest = max(map(len, scores))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    memo = {}
    got = {r.doc_id: r for r in tc.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        pieces = own.split(d.text or "")
        want = sum(memo.setdefault(p, brute(p.encode(), scores, longest)) for p in pieces)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_pretokens) == (want, len(pieces))
    assert len(got) == len(docs)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "the the", 7), (None, "the the", 7)], "doc_id long, text string, n_tokens long")
    assert sorted(r.n_pretokens for r in tc.count_tokens(df).collect()) == [0, 0, 2, 2]
    assert tc.count_tokens(df.limit(0)).count() == 0
