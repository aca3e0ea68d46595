"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle) and a join on the vertex, whose
large keys can be split, so a hub with many neighbours never meets in one task.  Edges are
written to the checkpoint folder after each round, so a lost executor costs one round.

A round is a plan of some ten shuffles, and plans are what fills the driver's memory when edges are few.  A caller may
therefore let up to ``at_driver`` edges be connected on the driver, which gives the same components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import cut

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("v")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger a, smaller b)."""
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("v")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def _connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, their roots): the larger of two joined roots takes the smaller one's, then all paths are shortened."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(vertices)), at[: len(a)], at[len(a) :]
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return vertices, vertices[root]


def components(edges: DataFrame, *, at_driver: int = 0) -> DataFrame:
    """From edges (a, b) of longs to (vertex, root): root is the smallest vertex that can be reached.

    Loops and repeated edges are harmless; vertices without an edge do not appear.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    seen = _signature(edges)
    if 0 < seen[0] <= at_driver:
        own = edges.toArrow()
        vertices, roots = _connected(own["a"].to_numpy(), own["b"].to_numpy())
        return cut(edges.sparkSession.createDataFrame(pa.table({"vertex": vertices, "root": roots})))
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        edges = cut(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
