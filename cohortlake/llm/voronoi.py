"""Exact top-k by integer inner product: a Voronoi kNN join.

One more component, ``sqrt(M^2 - |x|^2)`` with the largest norm ``M``, turns the
inner product into a Euclidean distance: ``d(q, x)^2 = |q|^2 + M^2 - 2 q.x``. Data
and queries go to the cell of their nearest pivot (a bounded sample). Each cell is
summed up: its count, and the distances of its ``k + 1`` objects nearest to the
pivot; a query group by its count and radius. From these summaries, a bound on
the distance of the k-th neighbour holds for a whole query group, and by the
triangle inequality only data in a ring around each pivot can be a neighbour.
Those rows go to the query group, in slices; each slice meets its queries, in
blocks, keeps its best k by integer inner product, and the best k of all slices
are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import matrix, one_per_id

EXACT = 2.0 ** 52  # sums of products below this are exact in double precision


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    return np.clip(a @ b.T, -2 ** 63, 2 ** 63 - 1)  # Python integers


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    d = ((v * v).sum(1) + extra ** 2)[:, None] + ((pivots * pivots).sum(1) + pivot_extra ** 2)[None, :]
    d -= 2 * (v @ pivots.T + extra[:, None] * pivot_extra[None, :])
    return np.sqrt(np.maximum(d, 0))


def group_bounds(between: np.ndarray, radius: np.ndarray, nearest: list[list[float]], k: int, slack: float):
    """``(low, high)``, both [query group, cell]: the ring of distances to the cell's
    pivot that holds all possible neighbours of the group's queries."""
    g = len(radius)
    low, high = np.full((g, len(nearest)), -np.inf), np.full((g, len(nearest)), np.inf)
    for i in range(g):
        reach = np.sort(np.concatenate([radius[i] + between[i, j] + np.asarray(nearest[j], dtype=float) for j in range(len(nearest))]))
        theta = reach[k] if len(reach) > k else np.inf  # one of k + 1 may be the query's own row
        low[i] = between[i] - radius[i] - theta - slack
        high[i] = between[i] + radius[i] + theta + slack
    return low, high


def knn_join(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
             scale: int = 1024, n_pivots: int = 8, slice_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """The ``k`` highest integer inner products of each query row with all other rows.

    Components become ``floor(scale * x)``. ``is_query`` is a condition on
    ``vec_id``. Returns ``query_id, rank, vec_id, score``; ties go to the smaller
    id; fewer rows if there are fewer candidates. Vectors that are null or hold
    null or non-finite components take no part, nor do null ids. Of rows with the
    same id the smallest vector takes part once. Shorter vectors count as ending
    in zeros, an empty one is the zero vector. Products beyond a long are held at
    its limits. No rows give none.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, "
                                      f"vec_id {vectors.schema[id_col].dataType.simpleString()}, score long")
    v = one_per_id(vectors, id_col, vector_col)
    v = v.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("v"))
    v = save(v.withColumn("q", F.coalesce(is_query, F.lit(False))), "integer-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = v.agg(F.max(norm).alias("m"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"]:
        return empty
    m2, dim, exact = top["m"], max(1, top["dim"]), top["m"] < EXACT
    slack = 1e-6 * (np.sqrt(m2) + 1)

    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()  # n_pivots rows
    pivots = matrix([r["v"] for r in sample], dim)
    pivot_extra = np.sqrt(np.maximum(m2 - (pivots * pivots).sum(1), 0))
    between = _distances(pivots, pivot_extra, pivots, pivot_extra)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["v"], dim)
                extra = np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))
                d = _distances(x, extra, pivots, pivot_extra)
                out = b.assign(cell=d.argmin(1).astype(np.int32), dist=d.min(1))
                dq = _distances(x, np.zeros(len(x)), pivots, pivot_extra)
                yield out.assign(q_cell=dq.argmin(1).astype(np.int32), q_dist=dq.min(1))

    kind = v.schema["vec_id"].dataType.simpleString()
    v = save(v.mapInPandas(assign, f"vec_id {kind}, v array<long>, q boolean, cell int, dist double, q_cell int, q_dist double"), "cells")

    # summaries: k + 1 smallest distances of parts of a cell, then of the cell
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    smallest = Window.partitionBy("cell", "part").orderBy("dist")
    near = (v.select("cell", "dist", part.alias("part")).withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
            .groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k + 1).alias("near")).collect())
    nearest: list[list[float]] = [[] for _ in pivots]
    for r in near:
        nearest[r["cell"]] = r["near"]
    groups = {r["q_cell"]: r for r in v.where("q").groupBy("q_cell").agg(F.max("q_dist").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    if not groups:
        return empty
    radius = np.array([groups[i]["r"] if i in groups else 0.0 for i in range(len(pivots))])
    low, high = group_bounds(between, radius, nearest, k, slack)
    ring = [(j, i, float(low[i, j]), float(high[i, j])) for i in groups for j in range(len(pivots))]
    rings = spark.createDataFrame(ring, "cell int, grp int, low double, high double")  # at most n_pivots^2 rows

    needed = (v.join(F.broadcast(rings), "cell").where((F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high"))))
    counts = {r["grp"]: r["n"] for r in needed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame([(i, -(-counts.get(i, 1) // slice_rows), -(-groups[i]["n"] // query_rows)) for i in groups],
                                  "grp int, slices long, blocks long")
    needed = (needed.join(F.broadcast(sizes), "grp")
              .select("vec_id", "v", "grp", F.pmod(F.xxhash64("vec_id"), F.col("slices")).alias("slice"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
    queries = (v.where("q").join(F.broadcast(sizes), F.col("q_cell") == F.col("grp"))
               .select(F.col("vec_id").alias("asked"), F.col("v").alias("q_v"), F.col("grp").alias("q_grp"),
                       F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("q_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("q_slice")))

    def solve(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            data = data.sort_values("vec_id", kind="stable")
            ids, x = data["vec_id"].to_numpy(), matrix(data["v"], dim, np.float64 if exact else object)
            for at in range(0, len(asked), 256):
                some = asked.iloc[at:at + 256]
                score = _products(matrix(some["q_v"], dim, np.float64 if exact else object), x, exact)
                for q, s in zip(some["asked"], score, strict=True):
                    other = np.flatnonzero(ids != q)
                    s = s[other]
                    if len(s) > k:  # all that reach the k-th highest, then the smaller ids among equals
                        reach = np.sort(s)[-k] if not exact else np.partition(s, len(s) - k)[len(s) - k]
                        on = np.flatnonzero(s >= reach)
                    else:
                        on = np.arange(len(s))
                    on = on[np.argsort(-s[on], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[other[on]], "score": s[on].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    best = (needed.groupBy("grp", "slice", "block").cogroup(queries.groupBy("q_grp", "q_slice", "q_block"))
            .applyInPandas(solve, f"query_id {kind}, vec_id {kind}, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
