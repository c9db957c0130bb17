"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to smaller nodes (partial aggregation, joins with skew handling) and is stored
below the shared checkpoint folder; links never meet in one task or on the driver. The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` of two long columns (null or equal ends link nothing) to (node, root): root is the smallest node
    reachable; nodes without a link are absent."""
    spark = links.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = links.where(x.isNotNull() & y.isNotNull())
    edges = stored(spark, links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                   .where("u > v").distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        large = stored(spark, large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(spark, small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


class Forest:
    """Union-find over the links that one task has seen; ``join`` says whether a link was needed."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def spanning_links(n: int, neighbours) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1; ``neighbours(i)`` gives the linked positions above i as an array.
    Labels are an array, so a dense group costs one vector operation per node and per merge."""
    label, out = np.arange(n), []
    for i in range(n):
        near = neighbours(i)
        if not len(near):
            continue
        for lab in np.unique(label[near]).tolist():
            if lab != label[i]:
                j = int(near[np.argmax(label[near] == lab)])
                out.append((i, j))
                label[label == lab] = label[i]
    return out
