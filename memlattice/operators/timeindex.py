"""A stored index of versions: by item and time for look-ups, by start for ranges, so that neither reads the table of versions."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.operators.temporal import valid_at

_ROW = "item_id string, version int, valid_start timestamp_ntz, valid_end timestamp_ntz, tx_start timestamp_ntz"


class VersionIndex:
    """Segments of versions (item_id, version, valid_start, valid_end, tx_start) in a folder that all executors share.

    Each segment is written twice: in folders by a hash of the item, sorted by item and start there, and in folders by
    the month of the start, sorted by start.  So a look-up prunes folders by bucket and row groups by item, and a range
    prunes folders by month and row groups by start.  A segment is seen once its name is written, which is last: a job
    that fails on the way leaves a segment that nobody reads.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, item: Column) -> Column:
        return F.pmod(F.xxhash64(item), F.lit(self.buckets)).cast("int")

    def add(self, versions: DataFrame) -> None:
        """Index versions; other columns are left out, and a version that is added again is one version to every look-up.

        A null item or start is found by no look-up; a null end is unbounded.  An item's rows may go over several files.
        """
        segment = uuid.uuid4().hex
        rows = versions.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in _ROW.split(", ")])
        by_item = rows.withColumn("bucket", self._bucket(F.col("item_id")))
        by_item.repartitionByRange("bucket", "item_id", "valid_start").sortWithinPartitions("bucket", "item_id", "valid_start").write.partitionBy("bucket").parquet(f"{self.path}/items/{segment}")
        by_start = rows.filter("valid_start is not null").withColumn("month", F.date_format("valid_start", "yyyyMM").cast("int"))
        by_start.repartitionByRange("valid_start", "item_id").sortWithinPartitions("month", "valid_start").write.partitionBy("month").parquet(f"{self.path}/starts/{segment}")
        named = self.spark.createDataFrame([(segment,)], "segment string")
        named.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _read(self, layout: str, folder: str) -> DataFrame:
        segments = sorted(r["segment"] for r in self.spark.read.schema("segment string").parquet(f"{self.path}/segments").collect())
        schema = f"{_ROW}, {folder} int"
        out = self.spark.createDataFrame([], schema)
        for segment in segments:
            out = out.union(self.spark.read.schema(schema).option("basePath", f"{self.path}/{layout}/{segment}").parquet(f"{self.path}/{layout}/{segment}"))
        return out

    def versions_of(self, items: list[str]) -> DataFrame:
        """All versions of some items: the items are a request's, not a table's."""
        wanted = sorted(r["b"] for r in self.spark.createDataFrame([(x,) for x in items], "item string").select(self._bucket(F.col("item")).alias("b")).distinct().collect())
        return self._read("items", "bucket").filter(F.col("bucket").isin(wanted) & F.col("item_id").isin(items)).drop("bucket")

    def version_at(self, items: list[str], at: datetime, time_type: str = "valid") -> DataFrame:
        """(item_id, version): the version with the latest start up to `at`, the largest among equals; none: no row.

        By valid time its interval, half-open, holds `at`: an earlier version may be the one where later ones have ended.
        By transaction time the end doesn't count.
        """
        t = F.lit(at).cast("timestamp_ntz")
        start = {"valid": F.col("valid_start"), "transaction": F.col("tx_start")}[time_type]
        held = valid_at(start, F.col("valid_end"), t) if time_type == "valid" else start <= t
        return self.versions_of(items).filter(held).groupBy("item_id").agg(F.max_by("version", F.struct(start, "version")).alias("version"))

    def items_starting(self, first: datetime, last: datetime) -> DataFrame:
        """(item_id): items of which a version starts on a day from first's to last's, both whole days."""
        month = lambda x: x.year * 100 + x.month
        low = F.lit(first.replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
        high = F.date_add(F.lit(last.date()), 1).cast("timestamp_ntz")
        rows = self._read("starts", "month").filter(F.col("month").between(month(first), month(last)) & (F.col("valid_start") >= low) & (F.col("valid_start") < high))
        return rows.filter("item_id is not null").select("item_id").distinct()

    def as_of(self, probes: DataFrame, period_seconds: int = 86_400) -> DataFrame:
        """probes (item_id string, at, ...) with version_at: the version by transaction time at each probe's own time, or null.

        Probes and versions are merged in order of time within an item's period; what was current before a period comes
        from a row for each item and period.  So work grows with probes plus versions, not with their product, and an
        item that holds much of the table is cut by periods.  Repeated probes are kept; null items or times find none.
        """
        if "version_at" in probes.columns:
            raise ValueError("version_at is the result's name")
        period = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (period_seconds * 1_000_000))
        found = self._read("items", "bucket").filter("item_id is not null and tx_start is not null")
        row = F.struct(*probes.columns)
        none = F.lit(None)
        asked = probes.select(F.col("item_id").alias("_item"), F.col("at").cast("timestamp_ntz").alias("_at"), F.lit(1).alias("_late"), none.cast("int").alias("_v"), row.alias("_p"))
        known = found.select(F.col("item_id").alias("_item"), F.col("tx_start").alias("_at"), F.lit(0).alias("_late"), F.col("version").alias("_v"), none.cast(asked.schema["_p"].dataType).alias("_p"))
        rows = asked.union(known).withColumn("_period", period(F.col("_at")))
        within = W.partitionBy("_item", "_period").orderBy("_at", "_late", "_v").rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy("_item").orderBy("_period").rowsBetween(W.unboundedPreceding, -1)
        ends = rows.groupBy("_item", "_period").agg(F.max(F.when(F.col("_late") == 0, F.struct("_at", "_v"))).alias("_end"))
        carried = ends.select("_item", "_period", F.last("_end", True).over(before)["_v"].alias("_carried")).withColumnsRenamed({"_item": "_i", "_period": "_k"})
        here = rows.withColumn("_here", F.last("_v", True).over(within)).filter("_late = 1")
        joined = here.join(carried, (F.col("_item") == F.col("_i")) & (F.col("_period") == F.col("_k")), "left")
        return joined.select("_p.*", F.coalesce("_here", "_carried").alias("version_at"))
