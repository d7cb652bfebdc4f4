"""Near-duplicates by ProbMinHash.

A document is its set of five-word shingles. In ProbMinHash every shingle sends a Poisson process of arrivals, at the rate of its
weight, to random slots; a slot keeps the shingle that arrived first, and a shingle ends once its next arrival comes after all slots' times. Two documents agree in a
slot with their probability Jaccard similarity. All shingles have weight 1 here, however often they occur, so that this is the Jaccard similarity of the sets, by which links are decided.
Bands of slots make candidates; those are verified by the Jaccard similarity of the whole sets, of 32-bit hashes of shingles, and the links found are joined into classes.

Documents with equal sets are one node from the start. In every bucket all pairs of nodes are settled. First each node is compared with one other, the most popular it meets, which settles groups of copies of a text that are all alike to one of them. What buckets then still
have nodes of more than one class, all their pairs across classes are compared: in small buckets as rows; in large ones in one task for each CELL x CELL nodes, where a matrix product of their sets gives every similarity exactly, and only links that join classes leave the task.

Defined results: words are split at white space, in lower case; a text of fewer than five words is one shingle; null texts and texts without words are alike;
class_id is the least id of the class (null if all are null); repeated rows are in one class; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.graph import components
from molframe.llm.rows import sent, sent_type, small_batches
from molframe.session import scratch_tables, sweep, table, written

SHINGLE, LEAST = 5, 0.8
#: At a similarity of 0.8 two documents meet in none of the bands with a probability of 5e-8.
BANDS, BAND_SLOTS = 32, 4
SLOTS = BANDS * BAND_SLOTS
#: Nodes of a bucket that are compared as rows, at most; larger buckets are compared as matrices, CELL nodes against CELL, COLUMNS shingles at once. Both compare all pairs that aren't settled.
FEW, CELL, COLUMNS = 8, 500, 4096
#: Words whose shingles are held at once; distinct words whose hashes a worker remembers.
BLOCK_WORDS, REMEMBERED = 100_000, 100_000
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        """A hash of each shingle of the words, in order."""
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            known.update([(x, xxhash.xxh64_intdigest(x)) for x in set(words) if x not in known])
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(w))
        out = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        return mixed(out)

    def distinct(self, text: str | None) -> np.ndarray:
        """Distinct 32-bit shingles of a text, sorted."""
        return np.unique((self.hashes((text or "").lower().split()) >> np.uint64(32)).astype(np.uint32))


def prob_min_hash(shingles: list[np.ndarray], weights: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The shingle that came first, for each document and slot; documents without shingles have none (_NEVER)."""
    size = np.array([len(s) for s in shingles])
    doc = np.repeat(np.arange(len(size)), size)
    element = np.concatenate([*shingles, np.empty(0, np.uint32)]).astype(np.uint64)
    rate = np.concatenate([*weights, np.empty(0)])
    first = np.full(len(size) * slots, _NEVER)
    time = np.zeros(len(element))
    for arrival in range(1 << 30):
        if not len(element):
            break
        x = mixed(element + np.uint64((arrival + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((x >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)) / rate
        # arrival time and element in one number that orders by time, then element
        np.minimum.at(first, doc * slots + ((x & np.uint64(0xFFFFFF)) % np.uint64(slots)).astype(np.int64), (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | element)
        if arrival < 4 or arrival % 4 == 0:
            last = (first.reshape(-1, slots).max(1) >> np.uint64(32)).astype(np.uint32)
            on = time.astype(np.float32).view(np.uint32) <= last[doc]
            doc, element, rate, time = doc[on], element[on], rate[on], time[on]
    return np.where(first == _NEVER, _NEVER, first & np.uint64(0xFFFFFFFF)).reshape(len(size), slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of a document."""
    part = signature.reshape(len(signature), BANDS, BAND_SLOTS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), part.shape[:2]).copy()
    for k in range(BAND_SLOTS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out.view(np.int64)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node binary: digest of the set, n, bands array<long>, shingles array<int>) of every whole text."""

    small_batches(df)

    def run(batches):
        own = Shingler()
        for pdf in batches:
            ids, texts = list(pdf["id"]), list(pdf["text"])
            sets: list[np.ndarray] = []
            begin = held = 0
            for i, text in enumerate(texts):
                sets.append(own.distinct(text))
                held += len(sets[-1])
                if held >= BLOCK_WORDS or i == len(texts) - 1:
                    keys = band_keys(prob_min_hash(sets, [np.ones(len(s)) for s in sets]))
                    yield pd.DataFrame({
                        "id": pd.Series(ids[begin : i + 1], dtype=pdf["id"].dtype), "node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets],
                        "bands": [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], "shingles": [s.view(np.int32) for s in sets],
                    })
                    sets, begin, held = [], i + 1, 0

    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {sent_type(df, id_col)}, node binary, n int, bands array<long>, shingles array<int>")
    return out.withColumn("id", F.col("id").cast(df.schema[id_col].dataType))


def _sizes(m: Column, n: Column, least: float) -> Column:
    """Whether the sizes of two sets allow a link."""
    return F.least(m, n) >= F.greatest(m, n) * F.lit(least) - F.lit(1e-9)


def possible(pairs: DataFrame, one: str, other: str, least: float) -> DataFrame:
    """(a, b), a < b: of pairs (one, other: node and n) those whose set sizes allow a link."""
    pairs = pairs.filter(_sizes(F.col(f"{one}.n"), F.col(f"{other}.n"), least))
    return pairs.select(F.least(f"{one}.node", f"{other}.node").alias("a"), F.greatest(f"{one}.node", f"{other}.node").alias("b")).distinct()


def shared(members: DataFrame) -> DataFrame:
    """members (band, node, n) of the buckets with two nodes or more, with the bucket's size. All else works on these, of which there are far fewer."""
    buckets = written(members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    return written(members.join(buckets, "band"), "members")


def with_hubs(members: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: each node with one other at most, the most popular of all it shares a bucket with that its set's size allows a link to. A node is popular that meets many others in its buckets: among edited copies of a text the text itself."""
    popular = members.groupBy("node").agg(F.sum("size").alias("met"))
    rows = members.join(popular, "node")
    hubs = written(rows.groupBy("band").agg(F.max(F.struct("met", "node", "n")).alias("hub")), "hubs")
    near = rows.join(hubs, "band").filter((F.col("node") != F.col("hub.node")) & _sizes(F.col("n"), F.col("hub.n"), least))
    best = near.groupBy("node").agg(F.max(F.struct("hub.met", "hub.node")).alias("hub"))
    return best.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def unsettled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with label, of the buckets in which nodes are of more than one component."""
    rows = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ones = written(rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") != F.col("y")).select("band"), "mixed")
    return written(rows.join(mixed_ones, "band", "left_semi"), "unsettled")


def across(members: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of members of a bucket that are of different components. A bucket is dealt to the cells of a square, each of about CELL x CELL pairs."""
    side = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("node"), side).cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), side - 1)))
    one = rows.select("band", F.col("own").alias("x"), F.col("every").alias("y"), F.struct("node", "n").alias("one"), F.col("label").alias("one_label"))
    other = rows.select("band", F.col("every").alias("x"), F.col("own").alias("y"), F.struct("node", "n").alias("other"), F.col("label").alias("other_label"))
    pairs = one.join(other, ["band", "x", "y"]).filter((F.col("one.node") < F.col("other.node")) & (F.col("one_label") != F.col("other_label")))
    return possible(pairs, "one", "other", least)


def linked(sets: list[np.ndarray], parts: np.ndarray, labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of sets of Jaccard similarity `least` or more, enough of them that with equal labels they connect all that such pairs connect. Only pairs of unlike parts count, where there are two."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = often[column] > 1  # what one set alone has is in no intersection
    renamed = np.cumsum(often > 1) - 1
    row, column = row[both], renamed[column[both]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - k] = 1
        same += block @ block.T
    alike = same / (size[:, None] + size[None, :] - same).astype(np.float64) >= least
    if len(np.unique(parts)) > 1:
        alike &= parts[:, None] != parts[None, :]
    out: list[tuple[int, int]] = []
    todo = np.ones(len(sets), bool)
    for root in range(len(sets)):  # trees of links, as wide as they come
        front = [root] if todo[root] else []
        todo[root] = False
        while front:
            i = front.pop()
            new = np.flatnonzero(alike[i] & todo)
            todo[new] = False
            front += new.tolist()
            out += [(i, j) for j in new.tolist() if labels[i] != labels[j]]
    return out


def dense_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between members (band, node, size, label) of a bucket that are of different components, as many as connect all that are linked; every pair is verified by the whole sets, and none but links leave the task.

    A bucket is dealt to CELL nodes a part; every two parts meet in a task."""
    small_batches(members)
    side = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("node"), side).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label").join(sets, "node")

    def solve(cell: list[tuple]) -> pd.DataFrame:
        nodes, owns, labels, shingles = ([r[k] for r in cell] for k in (1, 2, 3, 4))
        _, codes = np.unique(np.array(labels, object), return_inverse=True)
        pairs = linked([np.asarray(x, np.int32) for x in shingles], np.array(owns), codes, least) if codes.max() > 0 else []
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in pairs], columns=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for pdf in batches:
            cells = zip(pdf["band"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), strict=True)
            for row in zip(cells, map(bytes, pdf["node"]), pdf["own"].tolist(), map(bytes, pdf["label"]), pdf["shingles"], strict=True):
                if held and row[0] != held[0][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInPandas(run, "a binary, b binary").distinct()


def classes_of(members: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float = LEAST, dense: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """(node, label) of the nodes with links, or None: any two members (of `shared`) of a bucket that `verify` keeps of the pairs (a, b) are linked, directly or over others. `dense` gives the links of buckets of more than FEW nodes;
    without it they are settled pair by pair."""
    found = written(verify(with_hubs(members, least)).select("a", "b"), "links")
    labels = None if found.isEmpty() else components(found)
    left = unsettled(members, labels)
    if left.isEmpty():
        return labels
    few = left.filter(F.col("size") <= FEW) if dense else left
    links = found.union(written(verify(written(across(few, least), "pairs")).select("a", "b"), "links"))
    if dense:
        links = links.union(written(dense(left.filter(F.col("size") > FEW)), "links"))
    return None if links.isEmpty() else components(links)


def sets_of(nodes: DataFrame, sketch: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, from the sketches."""
    return written(sketch.select("node", "shingles").join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of LEAST or more, with it."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = both.select("a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("same"))
    return both.select("a", "b", (F.col("same") / (F.col("m") + F.col("n") - F.col("same"))).alias("likeness")).filter(F.col("likeness") >= LEAST)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_key binary, class_size): one row for each input row."""
    before = scratch_tables()
    sketch = written(sketches(df, id_col, text_col), "sketch")
    nodes = written(sketch.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "nodes")
    members = shared(nodes.select(F.explode("bands").alias("band"), "node", "n"))
    sets = sets_of(members, sketch)
    labels = classes_of(members, lambda pairs: verified(pairs, sets), dense=lambda rows: dense_links(rows, sets, LEAST))
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    placed = nodes.select("node", "id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = placed.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    placed = written(placed.select("node", "label").join(classes, "label"), "placed")
    sweep(df.sparkSession, before, sketch, placed)
    return sketch.select("id", "node").join(placed, "node").select(F.col("id").alias(id_col), "class_id", F.col("label").alias("class_key"), "class_size")


def one_of_each(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The row of df with its class's least id, for each class. Of repeated rows with that id one stays; rows without id stay if their class has no other."""
    first = classes.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy(F.col(id_col).alias("first_id")).agg(F.count("*").alias("rows"))
    rows = lambda more: df.join(first.filter((F.col("rows") > 1) & F.col("first_id").isNotNull() if more else (F.col("rows") == 1) | F.col("first_id").isNull()), F.col(id_col).eqNullSafe(F.col("first_id")), "left_semi")
    return rows(False).union(rows(True).dropDuplicates([id_col]))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
