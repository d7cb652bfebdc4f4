"""Grouping templates by position and UMI: identity, edit, adjacency and paired.

All work is on the distinct UMIs of a position group with their counts, never on reads. A group of one UMI needs none; groups of up to LOCAL distinct UMIs are clustered many to a task;
larger ones as a distributed fixpoint of least labels, in blocks of LOCAL ranks, over edges found by equal chunks (the pigeonhole rule), with the same result.

Rank in a group: count descending, then UMI ascending. identity: each UMI for itself. edit: connected components of at most k mismatches.
adjacency: a parent reaches a child within k mismatches whose count is at most count div 2 + 1; a UMI's label is the least rank that reaches it. paired: adjacency of
dual UMIs in canonical form, where a match may be in either orientation. UMIs with other letters than ACGT, or more than 32 of them, are molecules for themselves, after the others of their group
(in the order of their text); the others of a group must be of one length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.dna import distance, flipped
from molframe.operators.numbering import running_offsets
from molframe.session import written

LOCAL = 4000
#: Letters of a UMI that can be clustered, at most.
WIDEST = 32


def _codes(umis: list[str]) -> np.ndarray:
    width = max(map(len, umis))
    return np.frombuffer("".join(u.ljust(width, "\0") for u in umis).encode("latin-1", "replace"), np.uint8).reshape(len(umis), width)


def _near(x: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Which pairs of rows differ in at most k places."""
    out = np.zeros((len(x), len(other)), np.uint8)
    for j in range(x.shape[1]):
        out += x[:, j, None] != other[None, :, j]
    return out <= k


def local_labels(umis: list[str], counts: list[int], strategy: str, k: int) -> np.ndarray:
    """Root (its place in rank order) of each UMI; umis come in rank order."""
    x, n = _codes(umis), np.array(counts)
    reach = _near(x, x, k)
    if strategy == "paired":
        reach |= _near(x, _codes(["-".join(reversed(u.split("-"))) for u in umis]), k)
    if strategy != "edit":
        reach &= n[None, :] <= n[:, None] // 2 + 1
    np.fill_diagonal(reach, False)
    label = np.where(reach.any(1), -1, -2)  # -2: it reaches none
    own = np.arange(len(umis))
    for root in range(len(umis)):
        if label[root] >= 0:
            continue
        alone = label[root] == -2
        label[root] = root
        front = own[:0] if alone else own[root : root + 1]
        while len(front):
            front = np.flatnonzero(reach[front].any(0) & (label < 0))
            again = front[label[front] == -1]
            label[front] = root
            front = again
    return label


def _rank(keys: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("valid").desc(), F.when(F.col("valid"), F.col("n")).desc(), "umi"))


def _local(nodes: DataFrame, keys: list[str], strategy: str, k: int) -> DataFrame:
    """Groups one after the other, each begins at rank 1."""

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        umis, counts, valid = pdf["umi"].tolist(), pdf["n"].tolist(), pdf["valid"].to_numpy(bool)
        begin = np.flatnonzero(pdf["rank"].to_numpy() == 1).tolist()
        root = np.arange(len(pdf))
        for a, b in zip(begin, [*begin[1:], len(pdf)], strict=True):
            b = a + int(valid[a:b].sum())
            if b - a > 1:
                root[a:b] = a + local_labels(umis[a:b], counts[a:b], strategy, k)
        return pdf.assign(root_rank=pdf["rank"].to_numpy()[root], root=pdf["umi"].to_numpy()[root])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = np.flatnonzero(pdf["rank"].to_numpy() == 1)[-1]  # the last group may go on
            if last:
                yield solved(pdf.iloc[:last])
            held = pdf.iloc[last:]
        if held is not None:
            yield solved(held.reset_index(drop=True))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", root_rank int, root string"
    return nodes.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInPandas(run, shape)


def _met(nodes: DataFrame, keys: list[str], strategy: str, k: int) -> DataFrame:
    """The pairs of edges, a pair as often as chunks of it are equal. Tables of nodes are never broadcast: their files are small, their rows are not."""
    chunks = lambda umi: F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), F.substring(umi, F.floor(i * F.length(umi) / (k + 1)).cast("int") + 1, (F.floor((i + 1) * F.length(umi) / (k + 1)) - F.floor(i * F.length(umi) / (k + 1))).cast("int")).alias("s"), F.length(umi).alias("l")))
    left = nodes.select(*keys, F.col("rank").alias("a"), F.col("umi").alias("ua"), F.col("n").alias("na"), F.explode(chunks(F.col("umi"))).alias("chunk"))
    forms = F.array("umi", flipped(F.col("umi"))) if strategy == "paired" else F.array("umi")
    right = nodes.select(*keys, F.col("rank").alias("b"), F.col("n").alias("nb"), F.explode(forms).alias("ub")).withColumn("chunk", F.explode(chunks(F.col("ub"))))
    met = left.hint("merge").join(right.hint("merge"), [*keys, "chunk"]).filter(F.col("a") != F.col("b"))
    if strategy != "edit":
        met = met.filter(F.expr("nb <= na div 2 + 1"))
    width = nodes.agg(F.max(F.length("umi"))).first()[0] or 0
    # letter by letter up to the greatest width, as compiled code; pairs in a bucket are of one length
    unlike = sum((F.when(F.substring("ua", i, 1) != F.substring("ub", i, 1), 1).otherwise(0) for i in range(1, width + 1)), F.lit(0))
    return met.filter(unlike <= k).select(*keys, "a", "b")


def edges(nodes: DataFrame, keys: list[str], strategy: str, k: int) -> DataFrame:
    """(keys, a, b: ranks of parent and child) of all pairs of a group within k mismatches, and by counts where the strategy asks."""
    return _met(nodes, keys, strategy, k).distinct()


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, label, block: where it comes from) of the nodes that the links of a block reach: the least label of all that lead to them inside the block. rows are links (keys, block, a, b) and the labels known so far (a, label; b is 0)."""

    def solved(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        part = np.cumsum(first) - 1
        a, b, label = (pdf[c].to_numpy(np.int64) for c in ("a", "b", "label"))
        span = int(max(a.max(), b.max())) + 1
        link = b > 0
        nodes, at = np.unique(np.concatenate([part * span + a, (part * span + b)[link]]), return_inverse=True)
        own, to = at[: len(a)], at[len(a) :]
        best = nodes % span
        np.minimum.at(best, own[~link], label[~link])
        source = own[link]
        while True:
            new = best.copy()
            np.minimum.at(new, to, best[source])
            if (new == best).all():
                break
            best = new
        reached = np.unique(to)
        where = np.flatnonzero(first)[nodes[reached] // span]
        return pdf[[*keys, "block"]].iloc[where].reset_index(drop=True).assign(rank=nodes[reached] % span, label=best[reached])[[*keys, "rank", "label", "block"]]

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            by = pdf[[*keys, "block"]]
            first = np.zeros(len(pdf), bool)
            first[:1] = True
            for c in by.columns:
                x = by[c].to_numpy()
                first[1:] |= x[1:] != x[:-1]
            last = np.flatnonzero(first)[-1]  # the last block may go on
            if last:
                yield solved(pdf.iloc[:last], first[:last])
            held = pdf.iloc[last:]
        if held is not None:
            held = held.reset_index(drop=True)
            yield solved(held, np.arange(len(held)) == 0)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", rank int, label int, block int"
    return rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block").mapInPandas(run, shape)


def _fixpoint(nodes: DataFrame, keys: list[str], strategy: str, k: int, block: int = LOCAL) -> DataFrame:
    """Least labels, in rounds over blocks of `block` ranks of a group: a block is settled by the task that has its links, and labels go from block to block. A block goes another round only if a lesser label came from elsewhere."""
    place = lambda rank: F.floor((F.col(rank) - 1) / block).cast("int")
    links = written(_met(nodes, keys, strategy, k).select(*keys, place("a").alias("block"), "a", "b"), "umi-edges")
    labels = nodes.select(*keys, "rank", F.col("rank").alias("label"))
    rows = links.withColumn("label", F.lit(0))
    while True:
        least = lambda test: F.min(F.when(test, F.col("label")))
        reach = _spread(rows, keys).groupBy(*keys, "rank").agg(F.min("label").alias("near"), least(F.col("block") == place("rank")).alias("own"))
        known = labels.hint("merge").join(reach.hint("merge"), [*keys, "rank"], "left")
        labels = written(known.select(*keys, "rank", F.least("label", "near").alias("label"), F.least("label", "own").alias("own")), "umi-labels")
        open_ = labels.filter("label < own").select(*keys, place("rank").alias("block")).distinct()
        if open_.isEmpty():
            break
        again = labels.select(*keys, place("rank").alias("block"), F.col("rank").alias("a"), F.lit(0).alias("b"), "label").unionByName(links.withColumn("label", F.lit(0)))
        rows = again.join(open_.hint("merge"), [*keys, "block"], "left_semi")
        labels = labels.drop("own")
    roots = nodes.select(*keys, F.col("rank").alias("root_rank"), F.col("umi").alias("root"))
    rooted = nodes.hint("merge").join(labels.select(*keys, "rank", F.col("label").alias("root_rank")).hint("merge"), [*keys, "rank"])
    return rooted.join(roots.hint("merge"), [*keys, "root_rank"]).select(*nodes.columns, "root_rank", "root")


def cluster(reads: DataFrame, keys: list[str], umi: str = "umi", strategy: str = "adjacency", k: int = 1, local: int = LOCAL, block: int = LOCAL, count: str | None = None) -> DataFrame:
    """(keys, umi, n, valid, rank, root_rank, root) of every distinct UMI of every group; null UMIs have none. Where reads were counted before, `count` names their number. An error where UMIs to be compared are of unlike lengths."""
    nodes = reads.filter(F.col(umi).isNotNull()).groupBy(*keys, F.upper(umi).alias("umi")).agg((F.sum(count) if count else F.count("*")).alias("n"))
    if strategy == "identity":
        nodes = nodes.withColumn("valid", F.lit(True)).withColumn("rank", _rank(keys).cast("int"))
        return nodes.withColumn("root_rank", F.col("rank")).withColumn("root", F.col("umi"))
    nodes = nodes.withColumn("valid", F.col("umi").rlike("^[ACGT-]*$") & (F.length(F.translate("umi", "-", "")) <= WIDEST))
    group = Window.partitionBy(*keys)
    size = F.when(F.col("valid"), F.length("umi"))
    several = F.min(size).over(group) < F.max(size).over(group)
    counted = F.when(several, F.raise_error(F.lit("UMIs of a group differ in length"))).otherwise(F.count_if("valid").over(group))
    nodes = nodes.withColumn("rank", _rank(keys).cast("int"))
    if k == 0 and strategy == "edit":
        return nodes.withColumn("root_rank", F.col("rank")).withColumn("root", F.col("umi"))
    sized = written(nodes.withColumn("distinct", counted), "umi-nodes")
    alone = sized.filter(~F.col("valid") | (F.col("distinct") == 1)).drop("distinct").withColumn("root_rank", F.col("rank")).withColumn("root", F.col("umi"))
    sized = sized.filter(F.col("valid") & (F.col("distinct") > 1))
    found = alone.unionByName(_local(sized.filter(F.col("distinct") <= local).drop("distinct"), keys, strategy, k))
    large = sized.filter(F.col("distinct") > local)
    if large.isEmpty():
        return found
    return found.unionByName(_fixpoint(large.drop("distinct"), keys, strategy, k, block))


def local_ids(clusters: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """clusters with id, from 0 in each group: by UMI (identity), by the component's least UMI (edit), else by the root's rank; UMIs that aren't clustered come last."""
    if strategy == "identity":
        clusters = clusters.withColumn("order_", F.col("umi"))
    elif strategy == "edit":
        clusters = clusters.withColumn("order_", F.min("umi").over(Window.partitionBy(*keys, "root_rank")))
    else:
        clusters = clusters.withColumn("order_", F.col("root_rank"))
    place = Window.partitionBy(*keys).orderBy(F.col("valid").desc(), "order_")
    return clusters.withColumn("id", (F.dense_rank().over(place) - 1).cast("long")).drop("order_")


def number_molecules(clusters: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """clusters with mi, the molecule's number over all groups in the order of their keys."""
    ids = written(local_ids(clusters, keys, strategy), "molecules")  # needed twice: clusters are made once
    offsets = running_offsets(ids.groupBy(*keys).agg((F.max("id") + 1).alias("molecules")), keys, "molecules").drop("molecules")
    return ids.join(offsets, keys).withColumn("mi", F.col("offset") + F.col("id")).drop("offset", "id")


def paired_strand(umi: Column, root: Column) -> Column:
    """A if a dual UMI is nearer to its root as it is than with halves exchanged, else B."""
    return F.when(distance(root, umi) < distance(root, flipped(umi)), "A").otherwise("B")
