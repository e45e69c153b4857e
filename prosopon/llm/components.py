"""Connected components of a graph given as links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopon.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node of its component.

    `links` has columns a and b of one orderable type. Each round takes the smallest neighbour of every node
    (combined before the shuffle) and joins it back, so a node with very many links is split like any skewed join. Rounds are
    written to the shared folder; the driver sees two numbers per round. Links with a null end are left out.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "n")
        large = both.join(lowest, both.a == lowest.n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        small = large.join(least, large.a == least.n).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut_lineage(small.union(least.select("n", "low")).distinct(), "links")


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) in a forest of labels, in place of a loop over pairs; every label is a root afterwards."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
