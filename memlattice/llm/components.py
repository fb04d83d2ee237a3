"""Connected components of an edge table: parts contract to stars, then large-star and small-star steps join the parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _min_of(edges: DataFrame, hub: str, other: str) -> DataFrame:
    least = edges.groupBy(hub).agg(F.min(other).alias("least"))
    return least.select(F.col(hub).alias("hub"), F.least(F.col(hub), F.col("least")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.filter("b > a").join(_min_of(both, "a", "b").withColumnRenamed("hub", "a"), "a")
    return joined.select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a < b: every b's smaller neighbours, and b itself, move to the least of them."""
    joined = edges.join(_min_of(edges, "b", "a").withColumnRenamed("hub", "b"), "b")
    moved = joined.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return moved.filter("a < b").distinct()


#: Edges of a part, at most: what one task contracts in memory.
PART = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edges to stars around the least vertex of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(root(x), x) for x in parent]
    stars = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0].copy()), pa.array(stars[:, 1].copy())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): every vertex of edges (a, b) with the smallest vertex that it reaches.

    Edges come in parts of up to PART, each of which a task contracts to stars.  One part is all there is to do;
    several are joined by rounds of star steps until one changes nothing.  Every round is a table in the shared folder;
    only its row count and checksum reach the driver.
    """
    tidy = scratch.save(edges.filter("a <> b").select("a", "b"), f"{name}-in")
    parts = max(1, -(-tidy.count() // PART))
    dealt = tidy.repartition(parts) if parts > 1 else tidy.coalesce(1)
    now = scratch.save(dealt.mapInArrow(_contract, "a long, b long"), f"{name}-0")
    state, k = None, 0
    while parts > 1:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state, k = tuple(row), k + 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
