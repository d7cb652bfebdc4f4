"""Large ids, beside null ones, come through every operator as they are."""

import pytest

from molframe.llm import bpe, crf, neardup, ogg, quality, suffix, tokencount

IDS = [2**62 + 1, None, -(2**62) - 1, 7]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, "some words of a text, the same and not", i) for i in IDS], "doc_id long, text string, n_chars long").coalesce(1)


def ids(out):
    return sorted((r.doc_id for r in out.collect()), key=str)


@pytest.mark.parametrize(
    "make",
    [
        bpe.bpe_round_trip,
        bpe.bpe_encode,
        lambda d: bpe.bpe_decode(bpe.bpe_encode(d)),
        lambda d: crf.tag_languages(d, crf.Tagger([])),
        tokencount.count_tokens,
        ogg.ogg_round_trip,
        lambda d: ogg.ogg_packets(ogg.ogg_encode(d)).filter("serial = 1 AND packet = 0"),
        lambda d: quality.score_quality(d, None),
        suffix.remove_repeats,
        neardup.near_duplicates,
    ],
)
def test_ids(df, make):
    assert ids(make(df)) == sorted(IDS, key=str)


def test_kept_columns(df):
    assert sorted((r.n_chars for r in quality.score_quality(df, None, keep=("text", "n_chars")).collect()), key=str) == sorted(IDS, key=str)
    assert sorted((r.n_chars for r in bpe.bpe_encode(df, keep=("n_chars",)).collect()), key=str) == sorted(IDS, key=str)
    assert sorted((r.n_chars for r in suffix.remove_repeats(df, keep=("n_chars",)).collect()), key=str) == sorted(IDS, key=str)
