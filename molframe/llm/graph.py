"""Connected components of links, as joins of tables; nothing reaches the driver but the number of labels that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.session import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the least node of its component.

    Each round takes the least label among a node and its neighbours, then follows labels to their own labels, so labels travel
    doubling distances. Rounds are written to the shared folder."""
    edges = written(links.select(F.col("a"), F.col("b")).union(links.select(F.col("b"), F.col("a"))).filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    was = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hooked.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(was)
        if new.filter(F.col("label") != F.col("was")).isEmpty():
            discard(edges)
            return new.select("node", "label")
        labels, was = new.select("node", "label"), new
