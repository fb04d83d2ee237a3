"""Bi-temporal operators: as-of reads, histories, changes, interval joins, sessions, co-occurrence.

Intervals are half-open; a null end is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import LABELS


def valid_at(start: Column, end: Column, t: Column) -> Column:
    return (start <= t) & (end.isNull() | (t < end))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (b[1].isNull() | (a[0] < b[1])) & (a[1].isNull() | (b[0] < a[1]))


def version_at(versions: DataFrame, t: Column, keys: list[str]) -> DataFrame:
    """The newest version of each key whose transaction interval holds t."""
    rows = versions.filter(valid_at(F.col("tx_start"), F.col("tx_end"), t))
    rest = [c for c in versions.columns if c not in [*keys, "version"]]
    best = rows.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("m"))
    return best.select(*keys, "m.*")


def number_versions(rows: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """version, previous_version and the transaction end, which is the next version's start."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"version": F.row_number().over(w), "tx_end": F.lead(start).over(w)}).withColumn("previous_version", F.when(F.col("version") > 1, F.col("version") - 1))


def changes(versions: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Versions that differ from the one before, with the names of the changed fields."""
    w = W.partitionBy(*keys).orderBy("version")
    old = {f"_{f}": F.lag(f).over(w) for f in fields}
    named = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return versions.withColumns(old).filter("version > 1").withColumn("changed", named).filter(F.size("changed") > 0).drop(*old)


def audit(versions: DataFrame, keys: list[str]) -> DataFrame:
    """action: created for a key's first version, deleted for a last one that has an end, else updated."""
    w = W.partitionBy(*keys).orderBy("version")
    action = F.when(F.lag("version").over(w).isNull(), "created").when(F.lead("version").over(w).isNull() & F.col("tx_end").isNotNull(), "deleted").otherwise("updated")
    return versions.withColumn("action", action)


#: Rows of a key on both sides that are compared in one go; keys with more are dealt to buckets of time.
CROWD = 2_000


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, width_days: int = 30) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap, with the overlap; b's columns have the suffix _b.

    Rows are joined by their keys.  Those of a key with more than CROWD rows are repeated in each bucket of width_days
    that they reach, and a pair counts in the bucket of the later start; unbounded ends reach to the last start of either
    side.  Rows without a start overlap none.
    """
    last = a.agg(F.max(start).alias("last")).union(b.agg(F.max(start))).agg(F.max("last").alias("last"))
    rows = a.select(*keys).union(b.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    crowded = rows.filter(F.col("n") > CROWD).select(*keys, F.lit(True).alias("_crowded"))
    crowded = F.broadcast(crowded) if crowded.limit(LABELS + 1).count() <= LABELS else crowded
    bucket = lambda c: F.floor(F.unix_date(c.cast("date")) / width_days)

    def dealt(df: DataFrame, suffix: str = "") -> DataFrame:
        top = df.filter(F.col(start).isNotNull()).join(crowded, keys, "left").join(F.broadcast(last), F.lit(True))
        upto = F.greatest(F.col(start), F.coalesce(F.col(end), F.col("last")))
        at = F.when(F.col("_crowded"), F.sequence(bucket(F.col(start)), bucket(upto))).otherwise(F.array(F.lit(None).cast("bigint")))
        # all columns in one order, so that a table joined with itself is shuffled once
        out = top.select(*df.columns, F.explode(at).alias("_at")).select("*", F.coalesce("_at", F.lit(0).cast("bigint")).alias("_bucket"))
        return out.select(*[F.col(c).alias(c if c in keys or c == "_bucket" else f"{c}{suffix}") for c in out.columns])

    joined = dealt(a).join(dealt(b, "_b"), [*keys, "_bucket"])
    s, e, s2, e2 = F.col(start), F.col(end), F.col(f"{start}_b"), F.col(f"{end}_b")
    once = F.col("_at").isNull() | (F.col("_bucket") == bucket(F.greatest(s, s2)))
    both_end = F.when(e.isNotNull() & e2.isNotNull(), F.least(e, e2))
    return joined.filter(overlaps((s, e), (s2, e2)) & once).drop("_bucket", "_at", "_at_b").withColumns({"overlap_start": F.greatest(s, s2), "overlap_end": both_end})


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Events with session (from 1 per key): a new one where the gap to the event before is larger."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def anchored_groups(events: DataFrame, keys: list[str], ts: str, window_seconds: int, tie: str) -> DataFrame:
    """(keys..., group, size, first_id): events within window_seconds of the group's first one (not of the one before); groups
    of one go.

    A stream over each partition's sorted rows that holds one open group, however many events a key has.
    """
    kinds = dict(events.dtypes)
    rows = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("id"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, anchor, group, size, first = None, 0, 0, 0, 0
        for frame in frames:
            out = []
            for *key, t, i in frame.itertuples(index=False, name=None):
                if key != name or t - anchor > window_seconds * 1_000_000:
                    if size > 1:
                        out.append((*name, group, size, first))
                    group = group + 1 if key == name else 1
                    name, anchor, size, first = key, t, 0, i
                size, first = size + 1, min(first, i)
            yield pd.DataFrame(out, columns=[*keys, "group", "size", "first_id"])
        if size > 1:
            yield pd.DataFrame([(*name, group, size, first)], columns=[*keys, "group", "size", "first_id"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "group long, size long, first_id long"])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "t", "id").mapInPandas(fold, schema)


def timeline(events: DataFrame, ts: str, grain: str) -> DataFrame:
    return events.groupBy(F.date_trunc(grain, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def coalesce_mutations(mutations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One operation for each key from its ordered adds, updates and deletes; keys whose changes cancel have no row.

    add + update = add, add + delete = nothing, update + update = update, update + delete = delete, delete + add = add,
    delete + anything else = delete.
    """
    listed = mutations.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "operation"))), lambda x: x["operation"]).alias("ops"))

    def step(acc: Column, op: Column) -> Column:
        return (
            F.when(acc == "", op)
            .when((acc == "add") & (op == "delete"), "")
            .when(acc == "add", "add")
            .when(acc == "update", F.when(op == "delete", "delete").otherwise("update"))
            .otherwise(F.when(op == "add", "add").otherwise("delete"))
        )

    return listed.select(*keys, F.aggregate("ops", F.lit(""), step).alias("operation")).filter("operation <> ''")
