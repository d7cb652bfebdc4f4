import random

import numpy as np
import pytest

from molframe.llm import neardup as nd

DIR = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Class of each (id, text) row number, by all pairs of different sets that share a shingle."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen, by = {}, {}
    for i, s in enumerate(sets):
        if s in seen:
            root[find(i)] = find(seen[s])
        else:
            seen[s] = i
            for x in s:
                by.setdefault(x, []).append(i)
    for s, i in seen.items():
        shared = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-12:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def same_partition(rows, got):
    want = brute(rows)
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(least.get(c, i), i)
    assert {i: least[c] for (i, _), c in zip(rows, want, strict=True)} == got


def test_estimate_of_probability_jaccard():
    r = np.random.default_rng(0)
    a = np.arange(1, 61, dtype=np.uint32) * np.uint32(7919)
    wa, wb = r.uniform(0.5, 4, 60), r.uniform(0.5, 4, 60)
    wa[:10], wb[50:] = 0, 0
    sig = nd.prob_min_hash([a[wa > 0], a[wb > 0]], [wa[wa > 0], wb[wb > 0]], 4096)
    want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(60)) for i in range(60) if wa[i] and wb[i])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    same_partition(rows, {r.doc_id: r.class_id for r in nd.op7_near_duplicates(spark, DIR).collect()})


def test_chains_and_edges(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(6):
        words = [r.choice(vocab) for _ in range(150)]
        for _ in range(25):  # each a small edit of the last one: the ends are unlike each other
            words = [*words]
            words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(i, "a b"), (i + 1, "A  b"), (i + 2, ""), (i + 3, None), (i + 4, "lone text of some seven words here"), (i + 5, "x y z " * 30000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int")
    out = nd.near_duplicates(df)
    same_partition(rows, {x.doc_id: x.class_id for x in out.collect()})
    again = df.union(df.filter("doc_id < 3")).union(spark.createDataFrame([(None, "an own text without any id at all", 1)], df.schema))
    kept = nd.one_of_each(again, nd.near_duplicates(again)).collect()
    want = {x.class_id for x in out.collect()} | {None}
    assert sorted(k.doc_id if k.doc_id is not None else -1 for k in kept) == sorted(-1 if w is None else w for w in want)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_star_of_edits(spark):
    """Edits of one text that are alike to it alone, not to each other: it is the only one to link them."""
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 1001):
        edit = [*words]
        for k in r.sample(range(8, 392, 8), 6):
            edit[k] = f"x{i}x{k}"
        rows.append((i, " ".join(edit)))
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.class_id for x in out} == {0} and len(out) == 1001


def test_all_pairs_of_buckets(spark, monkeypatch):
    """Links between any members of a bucket are found, in cells too, whichever its hubs are."""
    r = random.Random(5)
    names = [bytes([i]) for i in range(60)]
    order = r.sample(names, 60)
    linked = {tuple(sorted(p)) for p in zip(order[:40:2], order[1:40:2])} | {tuple(sorted(p)) for p in zip(order[1:10:2], order[2:10:2])}
    members = spark.createDataFrame([(band, x, 10) for band in (1, 2) for x in names], "band long, node binary, n int")
    links = spark.createDataFrame(sorted(linked), "a binary, b binary")
    monkeypatch.setattr(nd, "CELL", 7)
    labels = {bytes(x.node): bytes(x.label) for x in nd.classes_of(nd.shared(members), lambda pairs: pairs.join(links, ["a", "b"], "left_semi")).collect()}
    root = {x: x for x in names}
    for _ in names:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert labels == {x: root[x] for p in linked for x in p}


def test_much_repeated_line(spark):
    """A set similarity of 0.82 is found, however often the line occurs that one of the two texts lacks."""
    r = random.Random(6)
    rows = []
    for i in range(0, 20, 2):
        text, line = ([f"w{r.randrange(10**6)}" for _ in range(n)] for n in (204, 40))
        rows += [(i, " ".join(text)), (i + 1, " ".join(text + line * 1000))]
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in out} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("few", [8, 1])
def test_edited_copies_without_a_centre(spark, monkeypatch, few):
    """Copies of a text with ever more edits: links between any two, few to the most popular one; all cells and parts are used."""
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "CELL", 9)
    monkeypatch.setattr(nd, "COLUMNS", 64)
    r = random.Random(12)
    text = [f"w{r.randrange(4000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        own = list(text)
        for k in r.sample(range(300), i % 24):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    rows += [(i + 500, t) for i, t in rows[:30]]
    same_partition(rows, {x.doc_id: x.class_id for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()})


def test_links_connect_what_all_pairs_connect():
    r = random.Random(3)
    for _ in range(60):
        base = [r.randrange(1000) for _ in range(30)]
        sets = [np.unique(np.array(base[: r.randint(15, 30)] + [r.randrange(10**6) for _ in range(r.randint(0, 6))], np.int32)) for _ in range(r.randint(2, 20))]
        parts = np.array([r.randrange(2) for _ in sets])
        labels = np.array([r.choice([0, 1, 2, i + 9]) for i in range(len(sets))])
        two = len(set(parts.tolist())) > 1
        alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8  # noqa: B023, E731
        every = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j) and (not two or parts[i] != parts[j])]
        same = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]]
        got = nd.linked(sets, parts, labels, 0.8)
        assert all((max(x), min(x)) in every for x in got) and len(got) < len(sets)

        def classes(links):
            of = list(range(len(sets)))  # noqa: B023
            for i, j in [*links, *same]:  # noqa: B023
                a, b = of[i], of[j]
                of = [a if x == b else x for x in of]
            return [of.index(x) for x in of]

        assert classes(got) == classes(every)
