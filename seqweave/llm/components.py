"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join the same nodes as the edges a-b do."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        was = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = np.minimum(label, label[label])
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, was) and np.array_equal(label[x], label[y]):
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long), root being the least node of its component.

    Alternates large-star and small-star until no edge changes; each round is a written table, so lost
    executors cost one round at most. Duplicate edges and loops are allowed; nodes without edges don't appear.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    marked = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.col("u"), F.min("v").over(W.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).withColumn("m", F.min("v").over(W.partitionBy("u")))
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(small, "edges")
        # stars only: every v is a root, and the edges are those of the round before, as their number and two sums of hashes tell
        mark = tuple(after.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (0, 1)]).first())
        moved = mark != marked
        marked = mark
        discard(now)
        now = after
        if not moved:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
