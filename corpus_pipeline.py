"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, broadcast_if_small
from memlattice.llm.decontaminate import contamination
from memlattice.llm.line_dedup import dedup_lines
from memlattice.llm.mixing import mix_sources
from memlattice.llm.near_dedup import near_duplicates
from memlattice.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores as toxic go.

    Null and empty texts score as texts without hits and stay; a null doc_id is no label's; repeated rows share their
    fate, and no rows give none.  All columns pass, whatever their names.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents (doc_ids) or more go; every document stays, with the text that remains.

    Null texts stay null, n_chars is counted anew.  Rows with null doc_id lose lines but make none common; repeated rows
    count once.  Other columns pass as they are, whatever their names.
    """
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; shingles of five words, similarity 0.8.

    Texts without words, null ones and rows with null doc_id are in no group and stay.  A doc_id names one document: rows
    that repeat it are kept or go together.  The texts are shuffled only if there are too many ids to broadcast.
    """
    found = near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept"))
    gone = broadcast_if_small(Scratch(spark, "near-gone").save(found.select("doc_id").distinct(), "gone"))
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, by doc_id (null too) and text.

    Null and empty texts, on either side, hold nothing and stay; so does everything if there is no benchmark.  Of rows
    that repeat a doc_id only those with a contaminated text go.
    """
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keyed=True).filter("contaminated")
    gone = broadcast_if_small(Scratch(spark, "contaminated").save(found.select("doc_id", "text_hash").distinct(), "gone"))
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken.

    Null sources are one source; null and empty texts have size 0 and nothing taken; repeated rows are rows of their own.
    """
    return mix_sources(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: A learned lexicon can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
