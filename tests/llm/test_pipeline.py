from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from molframe.llm import mix, quality
from molframe.llm.bpe import RANKS, Codec

from .test_mix import check
from .test_neardup import brute as classes
from .test_suffix import brute as repeats

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        f(spark, docs, DIR).write.parquet(f"{at}/{name}")
        out.append(docs := spark.read.parquet(f"{at}/{name}"))
    return out


def test_columns(stages):
    assert all(set(d.columns) == set(stages[0].columns) for d in stages[1:-1])
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "repeats", "mix", "tokens"]


def test_quality(spark, stages):
    network = quality.train_quality(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = stages[0].collect()
    score = network.score([(r.text or "").encode() for r in rows])
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r, s in zip(rows, score, strict=True) if s >= 0.7}


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    least = {}
    for (i, _), c in zip(rows, classes(rows), strict=True):
        least[c] = min(least.get(c, i), i)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(least.values())


def test_repeats(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    n = {i: a - b for (i, _), (a, b, _, _) in zip(rows, repeats([t for _, t in rows], cp.PASSAGE), strict=True)}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert got.keys() == n.keys() and all(n[i] - 6 <= len(r.text.encode()) <= n[i] and r.n_chars == len(r.text) for i, r in got.items())


def test_mix(stages):
    got = mix.mix_sources(stages[3])
    check(got.collect(), [(r.source, len((r.text or "").split())) for r in stages[3].collect()])
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({r.doc_id: r.copies for r in got.collect() if r.copies})


def test_tokens(stages):
    import public_tokenizers as P

    own = Codec(P.path(RANKS), P.PATTERN)
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert r.text == text[r.doc_id] and r.n_tokens == len(r.ids) and ",".join(map(str, r.ids)) == next(own.encode_texts([r.text]))


def test_run_and_empty(spark, stages):
    assert cp.run(spark, DIR).agg(F.sum("n_tokens")).first() == stages[5].agg(F.sum("n_tokens")).first()
    for _, f in cp.STAGES:
        assert f(spark, stages[0].limit(0), DIR).count() == 0


def test_built_cases(spark, stages):
    """Nulls in every column, empty, very long and repeated texts, ties, and extra columns with names that stages use themselves."""
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in stages[0].limit(60).collect()]
    long = " ".join(f"word{i % 977} and some more of it" for i in range(20_000))
    passage = " ".join(f"shared{i}" for i in range(90))
    cases = [(None, None, None, None, None), (None, "", "en", None, 0), (7_000_000, long, "en", "s", len(long)), (7_000_001, long, "en", "s", len(long)), (7_000_002, f"{passage} one", None, "s", None), (7_000_003, f"two {passage} and others here", None, "s", None)]
    cases += [own[0], own[0], (own[1][0], own[2][1], "xx", "", 1), (2**60, "é" * 500, None, "é", 1)]
    extra = ["score", "kept", "spans", "node", "id_", "text_", "copies", "label", "class_id", "first_id", "n_bytes", "ids", "decoded", "found_", "cut_", "band"]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in own + cases], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    n = docs.count()
    for name, f in cp.STAGES:
        out = f(spark, docs, DIR)
        rows = out.collect()
        if name != "tokens":
            assert sorted(out.columns) == sorted(cp.COLUMNS)
            docs = spark.createDataFrame(rows, out.schema).select("*", *[F.lit("x").alias(c) for c in extra])
        assert 0 < len(rows) <= 2 * n
    assert all(r.n_tokens == len(r.ids) for r in rows)
