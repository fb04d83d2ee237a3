"""Structured Streaming: bucketed metrics, sessions, coalesced mutations and micro-batch sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from memlattice.operators.graph import upsert_latest
from memlattice.operators.temporal import coalesce_mutations

#: How late an event may come: a day, as long as buckets are kept.
LATE = "24 hours"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet file at path, or of the files in that folder."""
    schema = spark.read.parquet(path).schema
    # a glob, as the source takes plain paths for folders only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def tumbling(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(bucket, event_type, n, mean, error_rate) by event time, with a day's watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    out = at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"))
    return out.select(F.col("w.start").alias("bucket"), "event_type", "n", "mean", "error_rate")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, started, ended, n) of sessions that a gap ends."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    out = at.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def sample_by_type(events: DataFrame, rates: dict[str, float], key: str = "event_id") -> DataFrame:
    """Keeps a share of each type's events, chosen by a hash of the key; types without a rate stay whole."""
    share = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(float(r))) for k, r in rates.items()], F.lit(1.0)) if rates else F.lit(1.0)
    return events.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share * 1_000_000)


def run_batches(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs what is available through each(batch, id); offsets and state stay in folder, so a restart goes on from there."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def latest_table(stream: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """A stream's rows, the last one of each key: batches are files of their own, so a repeated batch overwrites itself."""
    spark = stream.sparkSession

    def write(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch_id", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/rows/{k}")

    run_batches(stream, folder, write, mode)
    rows = spark.read.option("recursiveFileLookup", True).schema(StructType([*stream.schema.fields, StructField("batch_id", IntegerType())])).parquet(f"{folder}/rows")
    return upsert_latest(rows, keys, [F.col("batch_id").alias("k")]).drop("batch_id")


def coalesced(stream: DataFrame, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """One operation for each key over all micro-batches of a stream of mutations.

    Each batch is coalesced by itself, and the batches' operations then are, in order.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, k: int) -> None:
        coalesce_mutations(batch, keys, order).withColumn("batch_id", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/rows/{k}")

    run_batches(stream, folder, write, "append")
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return coalesce_mutations(rows, keys, ["batch_id"])


def new_folder(root: str) -> str:
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
