"""Bounded samples of labelled documents, for what is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: Rows held out from learning have this remainder of crc32(doc_id) modulo FOLDS.
FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label) of at most `limit` labelled ids outside the held-out fold, those with the least hashes of their id.

    The limit is what makes the broadcast safe, and bounds the rows too: of an id that many rows repeat only the text with
    the least hash is learned from.  Labels that are null or contradict each other are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("m"))
    return one.select("m.text", "m.label")
