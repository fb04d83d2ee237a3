"""Ranked retrieval: token overlap, full text, BM25, cosine, reciprocal-rank fusion, fallback chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import scores as sc
from memlattice.functions import text as tx


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "item_id") -> DataFrame:
    """The k best rows by score, ties by key: a bounded heap in each task, no full sort."""
    return df.orderBy(F.desc(score), key).limit(k)


def keyword_search(items: DataFrame, text: str, k: int = 10, least: float = 0.1) -> DataFrame:
    """(item_id, score): Jaccard of the distinct words of item and query above `least`."""
    score = F.round(tx.jaccard(tx.tokens(F.lit(text)), tx.tokens(F.col("content"))), 6)
    return top_k(items.select("item_id", score.alias("score")).filter(F.col("score") > least), k)


def contains_search(items: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Items whose content holds the query, or half of its words at least; * returns all."""
    if text.strip() == "*":
        return items.orderBy("item_id").limit(k)
    asked = tx.tokens(F.lit(text))
    half = F.greatest(F.lit(1), F.floor(F.size(asked) / 2).cast("int"))
    hit = F.lower("content").contains(text.lower()) | (F.size(F.array_intersect(asked, tx.tokens(F.col("content")))) >= half)
    return items.filter(hit).orderBy("item_id").limit(k)


def full_text(items: DataFrame, text: str) -> DataFrame:
    """Items that hold every word of the query."""
    asked = tx.tokens(F.lit(text))
    return items.filter(F.size(F.array_except(asked, tx.tokens(F.col("content")))) == 0)


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(vec_id, score): the k rows nearest to the one row of query(q), by cosine; exact.

    The single query row is what is broadcast.
    """
    scored = vectors.join(F.broadcast(query.limit(1)), F.lit(True)).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top_k(scored if least is None else scored.filter(F.col("score") >= least), k, key="vec_id")


def rrf(lists: DataFrame, k: int, key: str = "item_id", base: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rows (list, rank, key): sum of 1 / (base + rank)."""
    return top_k(lists.groupBy(key).agg(F.round(F.sum(1 / (F.lit(base) + F.col("rank"))), 6).alias("score")), k, key=key)


def ranked(df: DataFrame, k: int, score: str = "score", key: str = "item_id") -> DataFrame:
    """The k best with their rank; only k rows meet in one task."""
    return top_k(df, k, score, key).withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def bm25(items: DataFrame, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item_id, score): BM25 over lower-cased words, scores divided by the largest.

    Term and document counts are aggregated for the query's words only; document lengths come from the same scan.
    """
    asked = sorted(set(text.lower().split()))
    if not asked:
        return items.select("item_id", F.lit(0.0).alias("score")).limit(0)
    w = tx.words(F.col("content"))
    times = lambda q: F.size(F.filter(w, lambda x: x == q)).cast("double")
    tf = [times(q).alias(f"tf{i}") for i, q in enumerate(asked)]
    docs = items.select("item_id", F.size(w).cast("double").alias("len"), *tf)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    idf = lambda i: F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    raw = docs.join(F.broadcast(stats), F.lit(True)).select("item_id", sum((part(i) for i in range(1, len(asked))), part(0)).alias("raw")).filter("raw > 0")
    return raw.join(F.broadcast(raw.agg(F.max("raw").alias("most"))), F.lit(True)).select("item_id", F.round(F.col("raw") / F.col("most"), 6).alias("score"))


def fallback(*strategies: DataFrame, k: int) -> DataFrame:
    """Rows (item_id, rank) of strategies in order of priority: each item once, at its best one."""
    rows = None
    for p, s in enumerate(strategies):
        part = s.select("item_id", "rank").withColumn("priority", F.lit(p))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("item_id").agg(F.min(F.struct("priority", "rank")).alias("b")).select("item_id", "b.priority", "b.rank")
    return best.orderBy("priority", "rank", "item_id").limit(k)


def matches_any(fields: list[Column], terms: list[str]) -> Column:
    """Any term as a substring of any field, whatever the case."""
    out = F.lit(False)
    for f in fields:
        for x in terms:
            out = out | F.lower(f).contains(x.lower())
    return out


def traverse(vectors: DataFrame, links: DataFrame, query: list[float], most: int = 8, by_centroid: bool = False, near: int = 10) -> DataFrame:
    """(place, vec_id): a walk from the vector nearest to the query, each step to the best neighbour not visited yet.

    Neighbours are up to `near` linked ones (links src, dst; the least first) and the `near` nearest vectors.  Best is
    most similar to the query or, by_centroid, what puts the centroid of query, current and candidate nearest to the
    query.  A step is one scan that hands 2 * near rows to the driver, which keeps the path; ties go to the smaller id.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = rows.select("vec_id", "v", F.round(sc.cosine(F.col("v"), q), 6).alias("s")).orderBy(F.desc("s"), "vec_id").first()
    path: list[int] = []
    now = first
    while now is not None and len(path) < most:
        path.append(now["vec_id"])
        here = F.array(*[F.lit(float(x)) for x in now["v"]])
        linked = links.filter(F.col("src") == now["vec_id"]).select(F.col("dst").alias("vec_id")).distinct().orderBy("vec_id").limit(near)
        alike = rows.filter(F.col("vec_id") != now["vec_id"]).select("vec_id", F.round(sc.cosine(F.col("v"), here), 6).alias("c")).orderBy(F.desc("c"), "vec_id").limit(near).select("vec_id")
        if by_centroid:
            gap = F.zip_with(F.zip_with("v", here, lambda a, b: a + b), q, lambda a, b: (a + b) / 3 - b)
            worth = -F.round(F.sqrt(sc.dot(gap, gap)), 6)
        else:
            worth = F.round(sc.cosine(F.col("v"), q), 6)
        left = rows.join(F.broadcast(linked.union(alike).distinct()), "vec_id", "left_semi").filter(~F.col("vec_id").isin(path))
        now = left.select("vec_id", "v", worth.alias("s")).orderBy(F.desc("s"), "vec_id").first()
    return vectors.sparkSession.createDataFrame(list(enumerate(path)), "place int, vec_id long")
