"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges (16 bytes each) that one task may solve at once; more are contracted by Spark, step by step.
LOCAL = 500_000


class Forest:
    """Union-find over 0 .. n - 1, by whole arrays of edges."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds edges between members a[i] and b[i]; the least member of a tree is its root."""
        while len(a):
            label = self.roots()
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(x, y)[differ], np.minimum(x, y)[differ])


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of the edges of one partition."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        forest.join(place[: len(a)], place[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest.roots()])], names=["id", "label"])


def connected(edges: DataFrame, local: int = LOCAL, most: int = 60) -> DataFrame:
    """(id, label) of all ends of edges(a, b), longs; the label is the least id of the component.

    Up to ``local`` edges are one task's arrays. More go through alternating large-star and small-star steps until nothing
    changes. A step groups by node and joins back, so a hub's neighbours are dealt out by AQE's skew join rather than
    gathered; the number of steps grows with the logarithm of the longest path. Steps are written to the shared folder.
    """
    edges = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= local:
        return common.written(edges.coalesce(1).mapInArrow(solve, "id long, label long"), "components")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        edges = common.written(small.filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select("b", "b").toDF("id", "label")).distinct()
