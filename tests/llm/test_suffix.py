import hashlib
import random
from collections import Counter

import pytest

from molframe.llm import suffix as sx

DIR = "/root/testdata/sf0.01"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        spans = sx.merged([(i, i + length) for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        yield len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def some_texts(r, n, length):
    """Texts with shared passages, edited copies and repeats within."""
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(length // 2) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [prose(r.randint(0, length // 2)) for _ in range(3)]
        if r.random() < 0.7:
            s = r.choice(shared)
            a, b = sorted(r.randrange(len(s)) for _ in range(2))
            parts.insert(1, s[a:b])
        if r.random() < 0.2:
            parts += [parts[0]] * 2
        if out and r.random() < 0.3:
            t = r.choice(out)
            k = r.randrange(len(t) + 1)
            parts = [t[:k], word(), t[k:]]
        out.append("".join(parts))
    return out


def test_maximal_repeats_against_brute_force():
    r = random.Random(8)
    for _ in range(60):
        contents = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        least = r.randint(1, 6)
        found = {}
        for n in range(least, 31):
            for c, x in enumerate(contents):
                for s in range(len(x) - n + 1):
                    found.setdefault(x[s : s + n], set()).add((c, s))
        want = set()
        for string, at in found.items():
            if len(at) > 1:
                side = lambda d: {contents[c][p] if 0 <= (p := s + d) < len(contents[c]) else (c, d) for c, s in at}  # noqa: B023, E731
                if len(side(-1)) > 1 and len(side(len(string))) > 1:
                    want.add((len(string), frozenset(at)))
        got = [(n, frozenset(zip(c.tolist(), s.tolist(), strict=True))) for n, c, s in sx.maximal_repeats(contents, least)]
        assert len(got) == len(set(got)) and set(got) == want


def run(df, length, gram):
    out = sx.remove_repeats(df, length=length, gram=gram)
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect()}


@pytest.mark.parametrize("group", [1000, 2])
def test_small_windows_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sx, "GROUP", group)
    monkeypatch.setattr(sx, "ARRAY_BYTES", 3000)
    r = random.Random(2)
    texts = [*some_texts(r, 120, 40), None, "", "ab" * 3000, "x" * 39, "y" * 40, "z" * 41, "q" * 100, "copy of a text that is there twice, no more", "copy of a text that is there twice, no more"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    assert run(df, 40, 8) == dict(enumerate(brute(texts, 40)))


def test_equal_sums_are_not_equal_strings(spark):
    """Strings over a Thue-Morse word have equal polynomial hashes modulo 2^64 for every odd base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(256))
    other = word.translate(str.maketrans("ab", "ba"))
    r = random.Random(3)
    middle = "".join(r.choice("cdefghijklmnop") for _ in range(64))
    df = spark.createDataFrame([(1, word + middle + other, 0), (2, other + middle + word, 0)], "doc_id long, text string, n_bytes int")
    assert run(df, 400, 64) == dict(enumerate(brute([word + middle + other, other + middle + word], 400), 1))
    assert all(x[1] == 0 for x in run(df, 400, 64).values())


@pytest.mark.parametrize("group", [1000, 3])
def test_groups_hold_all_occurrences(spark, monkeypatch, group):
    monkeypatch.setattr(sx, "GROUP", group)
    texts = [*some_texts(random.Random(7), 60, 40), None, "", "ab" * 200, "q" * 100]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [(t or "").encode() for t in texts]
    found = {}
    for r in sx.repeat_groups(df, length=40, gram=8).collect():
        found.setdefault((bytes(r.string), r.size), set()).add((r.doc_id, r.start))
    strings = {}
    for (key, size), at in found.items():
        own = {data[i][s : s + size] for i, s in at}
        assert len(at) > 1 and len(own) == 1 and len(max(own)) == size >= 40
        strings[max(own)] = at
    assert len(strings) == len(found)
    covered = [set() for _ in data]
    for string, at in strings.items():
        for i, s in at:
            covered[i].update(range(s, s + len(string)))
    assert [len(c) for c in covered] == [x[1] for x in brute(texts, 40)]
    if group == 1000:  # all occurrences there are
        for string, at in strings.items():
            assert at == {(i, s) for i, d in enumerate(data) for s in range(len(d) - len(string) + 1) if d[s : s + len(string)] == string}


def test_documents_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    want = {i: x for (i, _), x in zip(rows, brute([t for _, t in rows], 400), strict=True)}
    out = sx.op3_suffix_dedup(spark, DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want and len(out) == len(rows)
    shared = {i: x[1] for (i, _), x in zip(rows, brute([t for _, t in rows], sx.PASSAGE), strict=True)}
    assert {r.doc_id: r.n_shared for r in out} == shared


def test_passages_and_repeats(spark):
    """Nulls, repeated rows, runs that are long enough without a repeat of that size, and extra columns."""
    r = random.Random(11)
    texts = [*some_texts(r, 80, 40), None, "", "q" * 100, "copy of a text that is there twice, no more", "copy of a text that is there twice, no more"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1)], "doc_id long, text string, cover_ string, shared_ int")
    out = sx.repeats_and_passages(df, length=40, passage=20, gram=8).collect()
    every = [*texts, texts[0]]
    want = {i if i < len(texts) else None: (*x, y[1]) for i, (x, y) in enumerate(zip(brute(every, 40), brute(every, 20), strict=True))}
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256, x.n_shared) for x in out} == want and len(out) == len(every)
    assert sx.repeats_and_passages(df.limit(0)).count() == 0


def test_narrowed_contents_hold_what_is_shared():
    r = random.Random(5)
    for _ in range(200):
        offsets = [r.randint(0, 12) for _ in range(r.randint(1, 6))]
        contents = [bytes(r.choice(b"ab") for _ in range(k)) + b"##" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for k in offsets]
        got = sx.narrowed(contents, offsets, 6)
        for i, (c, k) in enumerate(zip(contents, offsets, strict=True)):
            left = right = 0  # the longest reach that any other has too
            for j, (d, m) in enumerate(zip(contents, offsets, strict=True)):
                if i != j:
                    left = max([left, *[n for n in range(min(k, m) + 1) if c[k - n : k] == d[m - n : m]]])
                    right = max([right, *[n for n in range(min(len(c) - k, len(d) - m) + 1) if c[k : k + n] == d[m : m + n]]])
            assert got[i] == ((k - left, k + right) if left + right >= 6 else (0, 0))


def test_arrays_get_only_what_may_be_shared(monkeypatch):
    """A content that shares its anchor, and no window, with others doesn't go to the array, nor do the ends that only one content has."""
    seen, whole = [], sx.maximal_repeats
    monkeypatch.setattr(sx, "maximal_repeats", lambda contents, least: seen.extend(contents) or whole(contents, least))
    contents = [b"a" * 30 + b"anchor#" + b"b" * 30, b"c" * 30 + b"anchor#" + b"d" * 30, b"x" * 10 + b"y" * 20 + b"anchor#" + b"b" * 30]
    rows = [(1, 0, k, k, k, k, 0, 1, 30, c) for k, c in enumerate(contents)]
    pdf = sx.pd.DataFrame(rows, columns=["k1", "k2", "d1", "d2", "c1", "c2", "first", "copies", "offset", "bytes"])
    out = sx.pd.concat(sx._arrays(35, every=False)(iter([pdf])))
    assert seen == [b"anchor#" + b"b" * 30] * 2
    assert out[["c1", "start", "end"]].to_numpy().tolist() == [[0, 30, 67], [2, 30, 67]]


def test_second_look_stays_within_runs(spark):
    r = random.Random(12)
    text = "".join(r.choice("abcdefgh") for _ in range(900))
    runs = [(100, 180), (170, 200), (400, 420), (600, 700)]
    assert sx.long_runs(sx.np.array([x for span in reversed(runs) for x in span]), 40) == [(100, 200), (600, 700)]
    df = spark.createDataFrame([(bytes(16), text, [x for span in runs for x in span]), (bytes(range(16)), text, [0, 900])], "node binary, text string, runs array<int>")
    met, _ = sx._occurrences(df, 40, 8, every=False)
    own = sorted((x.start, x.start + x.windows + 39) for x in met.filter("n1 = 0 and n2 = 0").collect())
    assert sx.merged(own) == [(100, 200), (600, 700)]
    got = {bytes(x.node): sx.merged([(s.start, s.end) for s in x.spans]) for x in sx._spans(df, 40, 8).collect()}
    assert got == {bytes(16): [(100, 200), (600, 700)], bytes(range(16)): [(100, 200), (600, 700)]}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "é" * 300, 1), (None, "é" * 300, 1)], "doc_id long, text string, n_bytes int")
    got = sx.remove_repeats(df, texts=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.kept) for r in got) == [(0, 0, ""), (600, 600, ""), (600, 600, "")]
    assert sx.remove_repeats(df.limit(0)).count() == 0


def test_blocks(monkeypatch):
    r = random.Random(1)
    data = "".join(some_texts(r, 60, 40)).encode()
    windows = len(data) - 39
    for block in (1 << 20, 1000):
        monkeypatch.setattr(sx, "BLOCK", block)
        _, _, _, start, n, _ = sx.Segmenter(40, 8).segments(data)
        assert start[0] == 0 and n.sum() == windows and (start[1:] == start[:-1] + n[:-1]).all()
