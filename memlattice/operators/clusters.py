"""Clusters: greedy seeds in parallel rounds, k-means with a capacity, near neighbours by cells of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Rounds
from .simjoin import capacity_clusters, close_vectors, cosine_pairs, first_fit, jaccard_pairs, near_vectors, set_classes, words

__all__ = ["close_vectors", "greedy", "greedy_vectors", "kmeans", "list_changes", "near_vectors", "semantic_temporal"]


def greedy(rows: DataFrame, block: list[str], text: str, order: str, threshold: float) -> DataFrame:
    """(block..., order, cluster): in order, each row joins the first seed of its block whose words are similar enough, or
    becomes one.

    The similar pairs come from a set-similarity join of the distinct texts, and seeds are decided in parallel rounds;
    equal sets of words follow the first of them.  order is unique over all rows.  Texts without words and null ones are
    seeds; a null block is a block; no rows give none.
    """
    rounds = Rounds(rows.sparkSession)
    tokens = rounds.save(rows.select(*block, order, words(F.col(text)).alias("tokens")))
    classes = rounds.save(set_classes(tokens, order, "tokens", block).select(F.col(order).alias("o"), F.when(F.size("tokens") > 0, F.col("first")).otherwise(F.col(order)).alias("first")))
    keys = classes.select(F.col("first").alias("key")).distinct()
    seeds = first_fit(keys, jaccard_pairs(tokens, order, "tokens", threshold, block), rounds.save)
    found = classes.join(seeds, F.col("first") == F.col("key")).select("o", "cluster")
    return tokens.join(found, F.col(order) == F.col("o")).select(*block, order, "cluster")


def kmeans(vectors: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """(vec_id, cluster) by k-means, seeded, with n // size clusters of `size` members each at most.

    Vectors bid for their nearest centroids in rounds, see capacity_clusters; those that none had room for, fewer than
    `size`, share one more cluster.  Vectors of fewer different values than clusters have their centroids several times.
    Null vectors are left out; fewer than two clusters are one.  The centroids reach the driver: one for `size` vectors.
    """
    known = vectors.filter("embedding is not null").select("vec_id", "embedding")
    n = known.count()
    k = n // size
    if k < 2:
        return known.select("vec_id", F.lit(0).cast("long").alias("cluster"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(known.select(array_to_vector("embedding").alias("features")))
    centres = model.clusterCenters()
    centroids = {c: [float(x) for x in centres[c % len(centres)]] for c in range(k)}
    return capacity_clusters(known, centroids, size, Rounds(vectors.sparkSession).save).select("vec_id", F.coalesce("cluster", F.lit(k).cast("long")).alias("cluster"))


def list_changes(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, op, old_from, old_to, new_from, new_to): edits that turn one ordered list into another."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for frame in frames:
            out = [(k, *code) for k, a, b in zip(frame[key], frame[old], frame[new], strict=True) for code in SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes() if code[0] != "equal"]
            yield pd.DataFrame(out, columns=[key, "op", "old_from", "old_to", "new_from", "new_to"])

    return rows.select(key, old, new).mapInPandas(run, f"{key} {kind}, op string, old_from int, old_to int, new_from int, new_to int")


def greedy_vectors(vectors: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, cluster): in order of ids, each vector joins the first cluster whose first member is near enough, or begins one.

    The near pairs are found by cells of blocks, and the first members in parallel rounds; equal vectors follow the
    least id of them.  Null vectors and zero ones begin clusters of their own.
    """
    rounds = Rounds(vectors.sparkSession)
    zero = F.coalesce(F.forall("embedding", lambda x: x == 0), F.lit(True))
    known = rounds.save(vectors.filter(~zero).select("vec_id", "embedding"))
    least = known.groupBy("embedding").agg(F.min("vec_id").alias("key"))
    classes = rounds.save(known.join(least, "embedding").select("vec_id", "key"))
    seeds = first_fit(classes.select("key").distinct(), cosine_pairs(least.withColumnRenamed("key", "vec_id"), cosine), rounds.save)
    return classes.join(seeds, "key").select("vec_id", "cluster").union(vectors.filter(zero).select("vec_id", F.col("vec_id").alias("cluster")))


def semantic_temporal(rows: DataFrame, key: str, order: str, text: str, alike: float = 0.3, scale: float = 1.0) -> DataFrame:
    """(key, order, cluster): in each key's order, an item joins the first cluster whose first item shares enough words and
    stands near enough (exp(-distance / scale) over 0.5), or begins one."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        seeds: list[tuple[int, frozenset]] = []
        out = []
        for at, value in part.sort_values(order)[[order, text]].itertuples(index=False, name=None):
            words = frozenset(value.lower().split())
            fit = next((k for k, w in seeds if words and w and len(words & w) / len(words | w) > alike and 2.718281828459045 ** (-(at - k) / scale) > 0.5), None)
            if fit is None:
                seeds.append((at, words))
            out.append((part[key].iloc[0], at, at if fit is None else fit))
        return pd.DataFrame(out, columns=[key, order, "cluster"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, cluster {kinds[order]}")
