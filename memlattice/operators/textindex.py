"""A stored inverted index of texts: postings in the order of their terms, so that a search reads only its own terms' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import text as tx

_POSTING = "bucket int, term string, item_id long, tf long, len long"
_STATS = "n long, total long"


class TextIndex:
    """Segments of postings (bucket, term, item_id, tf, len) and their sums, in a folder that all executors share.

    A bucket is a hash of the term and a folder of its own; within it files are sorted by term and item, and a frequent
    term's postings go over several files.  So a search prunes folders by bucket and row groups by term, and reads no
    text.  A segment is seen once its sums are written, which is last.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, items: DataFrame) -> None:
        """Index (item_id, content): lower-cased words between white space; items are not in the index yet.

        Null and empty contents have no words but count as items; repeated rows count again; a very long text is one item.
        """
        segment = uuid.uuid4().hex
        w = F.coalesce(tx.words(F.col("content")), F.array().cast("array<string>"))
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), w.alias("w"), F.size(w).cast("long").alias("len"))
        each = rows.select("item_id", "len", F.explode("w").alias("term"))
        counted = each.groupBy("term", "item_id", "len").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", self._bucket(F.col("term")))
        ordered = counted.repartitionByRange("bucket", "term", "item_id").sortWithinPartitions("bucket", "term", "item_id")
        ordered.select("term", "item_id", "tf", "len", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/segments/{segment}")
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
        sums.withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{self.path}/sums")

    def _sums(self) -> DataFrame:
        return self.spark.read.schema(f"{_STATS}, segment string").parquet(f"{self.path}/sums")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, item_id, tf, len) of some terms, over all segments."""
        paths = [f"{self.path}/segments/{r['segment']}" for r in self._sums().filter("total > 0").select("segment").collect()]
        if not terms or not paths:
            return self.spark.createDataFrame([], "term string, item_id long, tf long, len long")
        wanted = sorted(r["b"] for r in self.spark.createDataFrame([(x,) for x in terms], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect())
        found = None
        for path in paths:
            part = self.spark.read.schema(_POSTING).parquet(path).filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).select("term", "item_id", "tf", "len")
            found = part if found is None else found.union(part)
        return found

    def bm25(self, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(item_id, score): BM25 of the query's words, divided by the largest; items without any of them are left out."""
        hits = self.postings(sorted(set(text.lower().split())))
        total = self._sums().agg(F.sum("n").cast("double").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
        common = hits.groupBy(F.col("term").alias("c_term")).agg(F.count(F.lit(1)).cast("double").alias("df"))
        # a row for each word of the query, and one of sums
        rows = hits.join(F.broadcast(common), F.col("term") == F.col("c_term")).join(F.broadcast(total), F.lit(True))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        raw = rows.groupBy("item_id").agg(F.sum(part).alias("raw"))
        return raw.join(F.broadcast(raw.agg(F.max("raw").alias("most"))), F.lit(True)).select("item_id", F.round(F.col("raw") / F.col("most"), 6).alias("score"))

    def holding_all(self, text: str) -> DataFrame:
        """(item_id): items that hold every word of the query."""
        terms = sorted(set(text.lower().split()))
        return self.postings(terms).groupBy("item_id").agg(F.count_distinct("term").alias("k")).filter(F.col("k") == len(terms)).select("item_id")
