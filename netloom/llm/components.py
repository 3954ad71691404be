"""Connected components: spanning forests of the partitions, then one task or alternating large-star and small-star rounds.

A partition's edges are thinned to a spanning forest where they lie.  At most
``FEW`` edges that are left are joined by one task, without a shuffle.  More go
through rounds, all of them joins and grouped minima over edges; the driver only
compares a count and a checksum.  A node's edges are joined, not windowed, so a
hub with very many edges is split by adaptive execution.  Rounds are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import durable, map_arrow, no_shuffles_left

#: Edges (two numbers) that one task may join.
FEW = 500_000


class Forest:
    """Union-find over node names; a tree's root is its smallest node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def joins(self, x: int, y: int) -> bool:
        """Whether x and y were apart; they are together from now on."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _thinned(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges that join what the partition's edges before them left apart; a forest of ``most`` nodes is begun anew."""
    forest = Forest()
    for batch in batches:
        if len(forest.parent) > most:
            forest = Forest()
        keep = [forest.joins(u, v) for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.joins(u, v)
    nodes = np.array(list(forest.parent), np.int64)
    names = np.array([forest.root(x) for x in nodes.tolist()], np.int64)
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (nodes, names)], names=["node", "component"])


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge in the direction given, with m the smallest of u and its partners."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), two longs; a component's name is its smallest node."""
    apart = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    now, before = durable(map_arrow(apart, lambda it: _thinned(it, FEW), "u long, v long")), None
    if now.count() <= FEW:
        return durable(map_arrow(now.coalesce(1), _in_one_task, "node long, component long"))
    now = now.distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = durable(small.filter("u <> v").distinct())
        with no_shuffles_left(now.sparkSession):
            check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == before:
            break
        before = check
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
