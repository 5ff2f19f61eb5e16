"""Connected components of a table of links, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, release


class Joined:
    """Labels that are connected, within one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (above := self.parent.get(label, label)) != label:
            self.parent[label] = label = self.parent.get(above, above)
        return label

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def components(links: DataFrame) -> DataFrame:
    """The smallest node of its component for each node that occurs in `links` (a, b: long).

    Each step gives a node the smallest label among its neighbours and then the label of that label, so paths
    shorten by half; sums are combined before they are shuffled, so a node with very many links is no hot spot.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges = checkpointed(edges.union(edges.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("node"), F.least("a", "n").alias("label")))
    while True:
        heard = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", "label", F.least("label", "heard").alias("near")
        )
        # The new label of the label: what the node points at may itself have moved on.
        moved = checkpointed(nearer)
        target = moved.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = checkpointed(moved.join(target, "near").select("node", F.least("near", "far").alias("label"), (F.col("label") != F.least("near", "far")).alias("changed")))
        labels = new.select("node", "label")
        if new.filter("changed").isEmpty():
            release(links.sparkSession)
            return labels
