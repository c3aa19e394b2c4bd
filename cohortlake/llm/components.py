"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node.

    Alternating large-star and small-star steps on undirected edges: each links
    nodes to the smallest neighbour they know, until only stars are left. Every
    round is written to the shared folder; only two counts come to the driver.
    """
    e = save(edges.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        n = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("d")).first()
        if n["n"] == n["d"] and e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        e = save(small, "edges")


def local_roots(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``0..n-1`` over the edges ``u-v``, and
    over those that led to ``root``, a result of this function."""
    root = np.arange(n) if root is None else root
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
