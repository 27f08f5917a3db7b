"""Connected components of an edge table, by large-star and small-star rounds over combinable minimums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the components of a task's own links, as one link from each node but the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if (low == high).all():
            break
        # labels are roots here: the higher one of a link goes below the lower one, then all paths are shortened
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of edges (a, b: any orderable type) with the least node of its component: (node, root).

    Each round joins every edge with the least neighbour of its ends, found by a group-by that combines before
    the shuffle, and is written to the shared folder. Every round keeps the components and lowers the edges'
    ends, until all edges point at a root. Stars, the usual input here, take two rounds.
    """
    links = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's least neighbour (itself included)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        after = save(small, "links")
        inner = after.select(F.col("lo").alias("hi")).distinct().join(after.select("hi").distinct(), "hi", "left_semi")
        twice = after.groupBy("hi").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        links = after
        if inner.isEmpty() and twice.isEmpty():
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
