"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long); component: the least id reachable.

    Each round takes the least label among neighbours, by an aggregate that combines before its shuffle, and then
    jumps to the label's own label; rounds grow with the logarithm of the longest path. Tables of a round are written
    to the shared folder. No node, edge or label goes to the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = tk.stored(both, "edges")
    labels = tk.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("low"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("up_label"))
        new = tk.stored(low.join(up, low.low == up.up, "left").select("id", F.least("low", F.coalesce("up_label", "low")).alias("label"), (F.least("low", F.coalesce("up_label", "low")) != F.col("label")).alias("moved")), "labels")
        tk.discard(labels)
        labels = new
        if not new.where("moved").limit(1).count():
            tk.discard(both)
            return labels.select("id", F.col("label").alias("component"))
