import base64
import hashlib
import re
from itertools import islice

import pytest
from pyspark.sql import functions as F

from molframe.llm import spotsigs as s

DIR = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in s.ANCHORS:
            chain = list(islice((x for x in (words[k] for k in range(i + 1, len(words))) if x not in s.ANCHORS), s.CHAIN))
            if chain:
                out.add((w, *chain))
    return out or {("text", text)}


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        a, b, c = brute(t), brute(e), brute(nxt)
        yield i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(a), len(b), len(a & b) / len(a | b), len(a & c) / len(a | c)


def shape(r):
    n = [len(base64.b64decode(x)) // 4 for x in (r.fingerprint, r.edited_fingerprint)]
    return r.doc_id, r.n_chars, r.edited_sha256, *n, pytest.approx(r.near_edited), pytest.approx(r.near_next)


def test_documents_against_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    for rows in (4000, 7):
        monkeypatch.setattr(s, "RANGE_ROWS", rows)
        got = {r.doc_id: shape(r) for r in s.op4_spotsigs(spark, DIR).collect()}
        want = {r[0]: r for r in expected(docs)}
        assert got.keys() == want.keys()
        assert all(want[k] == got[k] for k in want)


def test_plan_is_native(spark):
    plan = s.op4_spotsigs(spark, DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(s, "table", lambda spark, d, n: d)
    rows = [(5, None), (5, "the cat sat"), (None, "of mice and men " * 4), (9_000_000_000, "the cat sat"), (-3, ""), (7, "the a of"), (8, "the long word list " * 20000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    for width in (1, 4000):
        monkeypatch.setattr(s, "RANGE_ROWS", width)
        got = s.op4_spotsigs(spark, df).collect()
        want = list(expected(rows))
        assert sorted(w[2] for w in want) == sorted(r.edited_sha256 for r in got)
        by = {(w[0], w[1]): w for w in want}
        assert all(by[(r.doc_id, r.n_chars)] == shape(r) for r in got)
    assert s.op4_spotsigs(spark, df.limit(0)).count() == 0
    one = s.op4_spotsigs(spark, df.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    equal = s.spot_fingerprints(df).filter(F.col("doc_id").isin(5, 9_000_000_000)).select("fingerprint").distinct().count()
    assert equal == 2


def test_bounds(spark):
    df = spark.range(1).select(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)).alias("a"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("b"), F.array(F.lit(1)).alias("c"))
    r = df.select(s.bounded_likeness(F.col("a"), F.col("b"), 0.8).alias("ab"), s.bounded_likeness(F.col("a"), F.col("c"), 0.8).alias("ac"), s.length_part(F.col("a"), 0.8).alias("pa"), s.length_part(F.col("b"), 0.8).alias("pb")).first()
    assert r.ab == 0.8 and r.ac is None and abs(r.pa - r.pb) <= 1


def test_classes_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    sets = {i: brute(t or "") for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in s.spot_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in ids}


def test_star_of_edits(spark):
    """Edits of one text that are alike to it alone: each lacks four of its 40 spots and has four of its own."""
    spots = [f"the k{i} l{i}" for i in range(40)]
    rows = [(0, " ".join(spots))]
    for i in range(1, 301):
        edit = [*spots]
        for j in range(4):
            edit[(i * 7 + j * 11 + i // 40 * j) % 40] = f"the x{i}x{j} y{i}"
        rows.append((i, " ".join(edit)))
    got = s.spot_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 301
