"""Set operations: canonical keys, entity merging, layer and schema differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_key(name: Column, kind: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), F.lit("|"), F.coalesce(F.lower(F.trim(kind)), F.lit("concept")))


def dedup_entities(rows: DataFrame, key: Column, confidence: str, order: str) -> DataFrame:
    """The most confident row of each key (ties: the least order); its null attributes come from the next ones."""
    rest = [c for c in rows.columns if c not in (confidence, order)]
    rank = F.struct((-F.col(confidence)).alias("r"), F.col(order))
    filled = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    return rows.withColumn("key", key).groupBy("key").agg(F.max(confidence).alias(confidence), F.min_by(F.col(order), rank).alias(order), F.count(F.lit(1)).alias("n_merged"), *filled)


def layer_diff(base: DataFrame, overlay: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): base_only, overlay_only, overridden or same."""
    both = base.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")).join(overlay.select(key, F.col(value).alias("o"), F.lit(True).alias("in_o")), key, "full")
    state = F.when(F.col("in_o").isNull(), "base_only").when(F.col("in_b").isNull(), "overlay_only").when(F.col("b").eqNullSafe(F.col("o")), "same").otherwise("overridden")
    return both.select(key, state.alias("state"))


def layered(base: DataFrame, overlay: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Base without hidden keys, overlay rows in place of its own."""
    return base.join(hidden.select(key), key, "left_anti").join(overlay.select(key), key, "left_anti").unionByName(overlay)


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tool, property, change, breaking) between rows (tool, property, type, required)."""
    k = ["tool", "property"]
    both = old.select(*k, F.col("type").alias("t1"), F.col("required").alias("r1")).join(new.select(*k, F.col("type").alias("t2"), F.col("required").alias("r2")), k, "full")
    change = F.when(F.col("t1").isNull(), "added").when(F.col("t2").isNull(), "removed").when(F.col("t1") != F.col("t2"), "type_changed").when(F.col("r1") != F.col("r2"), F.when(F.col("r2"), "required").otherwise("optional"))
    out = both.select(*k, change.alias("change"), F.col("r2").alias("now_required")).filter("change is not null")
    breaking = F.col("change").isin("removed", "type_changed", "required") | ((F.col("change") == "added") & F.coalesce("now_required", F.lit(False)))
    return out.select(*k, "change", breaking.alias("breaking"))


def map_diff(a: Column, b: Column) -> dict[str, Column]:
    """Keys that are only in b, only in a, or in both with other values, sorted."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    shared = F.array_intersect(ka, kb)
    return {"added": F.sort_array(F.array_except(kb, ka)), "removed": F.sort_array(F.array_except(ka, kb)), "changed": F.sort_array(F.filter(shared, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))}


def provenance(base: DataFrame, overlay: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """(key, layer): hidden, base, local (of the overlay alone) or override."""
    both = base.select(key, F.lit(True).alias("b")).join(overlay.select(key, F.lit(True).alias("o")), key, "full").join(hidden.select(key, F.lit(True).alias("h")), key, "left")
    layer = F.when(F.col("h"), "hidden").when(F.col("o").isNull(), "base").when(F.col("b").isNull(), "local").otherwise("override")
    return both.select(key, layer.alias("layer"))
