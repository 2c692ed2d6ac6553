"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.shared import looked_up, written


class Forest:
    """Disjoint sets of array positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A smaller edge list with the same components: each node to the smallest of its component."""
    nodes, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(which[: len(a)].tolist(), which[len(a) :].tolist()):
        forest.join(x, y)
    roots = np.array([forest.find(x) for x in range(len(nodes))], np.int64)
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _led(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Stored edges with m, which ``least`` (written here, a row per node) gives for their a; a hub's edges are split over tasks."""
    return looked_up(edges, written(least, "least"), ["a"])


def _round(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, then each node, are led to the smallest node next to it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    led = _led(both, both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    large = written(led.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    beside = _led(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return written(beside.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether each node is led to one node, and none that others are led to is led on itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
    return not odd.limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node but the smallest ones.

    ``edges`` has long columns a and b. Each round's edges are written to the shared folder; rounds
    end when all edges are stars. No edge or label comes to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = _round(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
