"""Approximate nearest neighbours by a permutation index: ordered nearest pivots, inverted files, footrule ranking, exact reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots: so many distinct vectors, those with the least hashes of their id.
PIVOTS = 512
#: A vector is posted in the files of this share of the pivots, its nearest ones; a query probes those of as many.
NEAREST = 0.25
#: Share of a block that is reranked, and the least number of vectors for each neighbour asked for.
SHARE, LEAST = 0.1, 32
#: Vectors of a block.
BLOCK = 8192
#: Bytes of the queries that meet the index at once.
CHUNK = 1 << 24


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors in double precision that are not null, not zero, of finite components and of the usual length."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with q, summed from the first component to the last, so that equal rows have equal ones."""
    dot, own = (np.cumsum(x * y, axis=1)[:, -1] for y in (q, x))
    return dot / (np.sqrt(own) * np.sqrt(np.cumsum(q * q)[-1]))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first; ties go to the earlier pivot."""
    return np.argsort(-(x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T, axis=1, kind="stable")[:, :n].astype(np.int16)


class Block:
    """The index of a block of vectors, by ascending id: for each pivot a file of (vector, place of the pivot in its order)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, vector: np.ndarray, place: np.ndarray, bounds: np.ndarray):
        self.ids, self.x, self.vector, self.place, self.bounds = ids, x, vector, place, bounds

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, posted: int) -> Block:
        rank = np.argsort(ids, kind="stable")
        ids, x = ids[rank], x[rank]
        pivot = nearest_pivots(x, pivots, posted).ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        bounds = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
        return cls(ids, x, (by_pivot // posted).astype(np.int32), (by_pivot % posted).astype(np.int16), bounds)

    def candidates(self, probe: np.ndarray, most: int) -> np.ndarray:
        """The `most` vectors with the least footrule distance to the query's order of pivots; ties: smaller vec_id.

        Only the files of the query's own pivots are read.  A pivot that a vector isn't posted under stands at the end
        of its order, so what a common pivot takes off the distance is the length of the order less the shift.
        """
        gain = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(probe.tolist()):
            a, b = self.bounds[pivot], self.bounds[pivot + 1]
            gain[self.vector[a:b]] += np.int32(len(probe)) - np.abs(self.place[a:b] - np.int16(at))
        if most >= len(gain):
            return np.arange(len(gain))
        return np.argpartition(np.arange(len(gain)) - gain.astype(np.int64) * len(gain), most - 1)[:most]

    def search(self, query_id: int, q: np.ndarray, probe: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        near = self.candidates(probe, max(LEAST * k, int(np.ceil(share * len(self.ids)))) + 1)
        near = near[self.ids[near] != query_id]
        if not len(near):
            return near, np.zeros(0)
        x = self.x[near]
        rough = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        if len(near) > k:
            keep = rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9
            near, x = near[keep], x[keep]
        score = _cosine(x, q)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][best], score[best]


_INDEX = "ids binary, x binary, vector binary, place binary, bounds binary"
_KINDS = (np.int64, np.float64, np.int32, np.int16, np.int64)


def _builder(pivots: np.ndarray, posted: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        block = Block.build(rows.column("vec_id").to_numpy(), x, pivots, posted)
        parts = (block.ids, block.x, block.vector, block.place, block.bounds)
        return pa.table({c.split()[0]: pa.array([p.astype(kind).tobytes()], pa.binary()) for c, p, kind in zip(_INDEX.split(", "), parts, _KINDS, strict=True)})

    return run


def build_index(rows: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """A row for each block of about BLOCK vectors of rows(vec_id, v), dealt by a hash of their id: its vectors and files."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, round(n / BLOCK)))))
    return dealt.groupBy("block").applyInArrow(_builder(pivots, max(1, int(NEAREST * len(pivots)))), _INDEX)


def _searcher(chunk: Broadcast, k: int, share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, probes = chunk.value
        for batch in batches:
            for row in batch.to_pylist():
                parts = [np.frombuffer(row[c.split()[0]], kind) for c, kind in zip(_INDEX.split(", "), _KINDS, strict=True)]
                parts[1] = parts[1].reshape(len(parts[0]), -1)
                block = Block(*parts)
                found = [block.search(i, q[j], probes[j], k, share) for j, i in enumerate(ids.tolist())]
                query = np.repeat(ids, [len(f) for f, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([f for f, _ in found]).astype(np.int64)), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors found nearest to each query by cosine, ties to the smaller vec_id.

    Every usable vector is posted under its nearest pivots in the inverted files of its block; only the pivots are a
    sample.  The index is built once, as a table in the shared folder, and every chunk of queries (CHUNK bytes, which
    bounds what is broadcast) meets all blocks.  In a block a query reads the files of its own nearest pivots, ranks the
    vectors there by the footrule distance between the orders, and reranks the best by exact cosines.

    Null, zero and non-finite vectors, those of an unusual length and null ids take no part.  A repeated query id is one
    query, by its least vector; a repeated candidate id is found as often as it occurs.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = usable(vectors)
    out = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "v").limit(2 * PIVOTS).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = list(dict.fromkeys(tuple(r["v"]) for r in sample))[:PIVOTS]
    pivots = np.array(distinct) / np.linalg.norm(distinct, axis=1, keepdims=True)
    index = scratch.save(build_index(rows, pivots, rows.count()), "index")
    asked = scratch.save(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    chunks = -(-n * 8 * pivots.shape[1] // CHUNK)
    found = scratch.save(spark.createDataFrame([], out), "found")
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow()
        if len(part):
            q = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
            chunk = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), q, nearest_pivots(q, pivots, max(1, int(NEAREST * len(pivots))))))
            found = scratch.append(index.mapInArrow(_searcher(chunk, k, share), out), "found")
            chunk.unpersist()
    scratch.keep_only("found")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP9_SQL = r"""
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS own FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) / (sqrt(r.own) * sqrt(q.own)) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 AND q.own > 0 AND r.own > 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
