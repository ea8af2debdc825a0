"""Connected components of a graph given as edges: contraction in each task, then alternating large and small stars.

Every task of at most EDGES edges replaces its edges by a star around each least node that it sees. If one task holds all
of them, that is the result. Else the stars of all tasks are joined by steps that rewire edges to the least neighbour known
so far (Kiveris et al., 2014): the number of steps grows with the logarithm of the longest chain, and the number of edges
never grows. A node with very many neighbours is one row on the side of the minima, so the joins can split it. Every step
is cut off by a checkpoint in the shared folder. The result is the same whatever the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.tables import checkpoint, mapped

EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the least of its component, and that least node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    more = root != np.arange(len(ids))
    return ids[more], ids[root[more]]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n > 2 * EDGES:  # a task holds that many; a forest is no larger than its nodes
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > EDGES:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["a", "b"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, forest(*map(np.concatenate, zip(*held, strict=True))))), names=["a", "b"])

    return edges.transform(mapped, run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node; nodes without an edge do not appear. edges: (a, b), no nulls; read twice, so a written table."""
    now = edges.select("a", "b").where("a <> b")
    tasks = math.ceil(now.count() / EDGES)
    now = checkpoint(_contracted(now.coalesce(max(1, tasks))))
    while tasks > 1:
        now = checkpoint(_small_star(_large_star(now)))
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        if ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR low > 0 AND high > 0").isEmpty():  # stars: each node has one edge down, and no centre has one
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
