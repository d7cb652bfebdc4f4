import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from molframe.llm import bpe


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    odd = ["", " ", "\n\n  \n", "a" * 3000, "ab" * 700, "é" * 500, "don't we'll I'd", "x y z  ", "½²³ 12٣ 漢字かな", "\x1c\x1d a\x85b", "🙂🙂 a🙂", "١٢٣", "$$$ ### !!", "Ünïcödé Straße"]
    odd += ["".join(r.choice("abcde fgh'st\n  éß🙂漢1²") for _ in range(r.randint(0, 400))) for _ in range(200)]
    odd += ["".join(r.choice("aàbcetion") for _ in range(r.randint(100, 2000))) for _ in range(40)]
    return odd


def test_codec_equals_library(enc):
    own = bpe.Codec(P.path(bpe.RANKS), P.PATTERN)
    for text, ids in zip(texts(), own.encode_texts(texts()), strict=True):
        assert ids == ",".join(map(str, enc.encode_ordinary(text))), text[:80]
        assert own.decode_text(ids) == text.encode()


def test_query_on_documents(spark, enc):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: ",".join(map(str, enc.encode_ordinary(r.text or ""))) for r in docs.collect()}
    got = bpe.op1_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    assert all(r.ids_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "ab ab", 7), (1, None, 5)], "doc_id long, text string, n_tokens long")
    got = bpe.bpe_encode(df).orderBy(F.col("n_tokens").desc()).collect()
    assert [r.n_tokens for r in got] == [2, 0, 0, 0] and got[0].doc_id is None
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    assert bytes(bpe.bpe_decode(bpe.bpe_encode(df)).agg(F.max("decoded")).first()[0]) == b"ab ab"
