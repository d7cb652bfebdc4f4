import re

import duckdb
import pytest
from pyspark.sql import functions as F

from molframe.llm import mix

DIR = "/root/testdata/sf0.01"


def brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by the stated rounds of resharing."""
    size = {}
    for s, n in rows:
        size[s] = size.get(s, 0) + n
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(size.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > most * size[s]}
        if not over:
            return size, target | {s: rate * weight[s] for s in open_}
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
        open_ -= over
    return size, target


def check(got, rows):
    size, target = brute(rows)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    most = max((n for _, n in rows), default=0)
    for s in taken:
        assert abs(taken[s] - target[s]) <= most / 2 + 1


def test_documents_against_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    got = mix.mix_sources(docs)
    check(got.collect(), rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.execute(mix.OP8_SQL).fetchall()
    have = [tuple(r) for r in mix.op8_mix(spark, DIR).collect()]
    assert sorted(have) == sorted(want)


def test_edges(spark):
    rows = [(1, "a b c", "x", 1)] * 7 + [(i, "word " * (i % 5), None if i % 3 else "é", 2) for i in range(60)] + [(None, None, "z", 3), (9, "", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix.mix_sources(df)
    check(got.collect(), [(r[2], len((r[1] or "").split())) for r in rows])
    assert got.count() == len(rows)
    assert got.filter("source = 'z'").agg(F.sum("taken")).first()[0] == 0
    assert mix.mix_sources(df.limit(0)).count() == 0
