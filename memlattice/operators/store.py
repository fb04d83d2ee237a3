"""Stores: merged properties, staged writes, snapshots of a graph, filtered documents, corpora and archives, all as tables in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as g


def folder(spark: SparkSession, label: str) -> str:
    return f"{g.shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def merge_maps(maps: Column) -> Column:
    """One map of an array of them; a later map's keys win."""
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(maps, none, lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))


def set_properties(rows: DataFrame, key: str, props: str, order: str) -> DataFrame:
    """(key, props): each key's property maps merged shallowly in order, new keys winning."""
    merged = merge_maps(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(F.map_entries(props).alias("e"))))), lambda x: F.map_from_entries(x["col2"]["e"])))
    return rows.groupBy(key).agg(merged.alias(props))


def merge_properties(nodes: DataFrame, mapping: DataFrame, key: str, props: str) -> DataFrame:
    """nodes (key, props) with those of mapping (old_id, new_id) merged into their targets: the target's values win, then the
    least source's; sources go."""
    moved = nodes.join(mapping.select(F.col("old_id").alias(key), "new_id"), key, "left")
    target = F.coalesce("new_id", key)
    entry = F.explode_outer(F.map_entries(props)).alias("e")
    rows = moved.select(target.alias("target"), F.struct(F.col("new_id").isNotNull().alias("moved"), F.col(key).alias("source")).alias("rank"), entry)
    values = rows.groupBy("target", "e.key").agg(F.min_by("e.value", "rank").alias("value"))
    return values.groupBy(F.col("target").alias(key)).agg(F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))).alias(props))


class Transaction:
    """Tables staged in a folder that readers don't see until commit names it; rollback deletes it.

    The commit is one small file, so a reader sees all of a transaction's tables or none.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.name = spark, root, uuid.uuid4().hex

    def write(self, df: DataFrame, table: str) -> None:
        df.write.parquet(f"{self.root}/staged/{self.name}/{table}")

    def commit(self) -> None:
        self.spark.createDataFrame([(self.name,)], "name string").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def rollback(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/staged/{self.name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
        """Rows of all committed transactions."""
        names = [r["name"] for r in spark.read.schema("name string").parquet(f"{root}/commits").collect()]
        return spark.read.schema(schema).parquet(*[f"{root}/staged/{n}/{table}" for n in names])


def dump_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges whose two ends are among them."""
    nodes = spark.read.schema(node_schema).json(f"{path}/nodes")
    return nodes, g.insert_edges(spark.read.schema(edge_schema).json(f"{path}/edges"), nodes)


def matches(filters: dict[str, object]) -> Column:
    """AND of equalities; {"$in": [...]} is membership for a scalar column and overlap for an array one (its name ends in [])."""

    def one(name: str, want: object) -> Column:
        if isinstance(want, dict):
            return F.arrays_overlap(F.col(name[:-2]), F.array(*[F.lit(x) for x in want["$in"]])) if name.endswith("[]") else F.col(name).isin(want["$in"])
        return F.col(name).eqNullSafe(F.lit(want))

    return reduce(and_, (one(k, v) for k, v in filters.items()), F.lit(True))


def page(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page of ordered rows: a bounded heap in each task."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def export_corpus(items: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, content, memory_type, entities) of items with content that are no versions, with the names that
    CONTAINS_ENTITY edges (src, dst) lead to."""
    kept = items.filter((F.coalesce(F.trim("content"), F.lit("")) != "") & (F.col("memory_type") != "Version"))
    named = edges.filter("edge_type = 'CONTAINS_ENTITY'").join(entities, F.col("dst") == F.col("entity_id")).groupBy(F.col("src").alias("item_id")).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    return kept.join(named, "item_id", "left").select("item_id", "content", "memory_type", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def knowledge(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) of a snapshot's JSON lines; lines that can't be read give nothing; a label is an alias of its own."""
    kind = "qid string, label string, entity_type string, confidence double, aliases array<string>"
    rows = lines.select(F.from_json("value", kind).alias("r")).select("r.*").filter("qid is not null")
    names = F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))
    return rows.select("qid", "label", "entity_type", "confidence"), rows.select("qid", F.explode(names).alias("surface"))


def best_alias(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, qid): the entity of each surface form with the highest confidence, ties to the lowest number."""
    number = F.regexp_extract("qid", r"(\d+)", 1).cast("long")
    return aliases.join(entities, "qid").groupBy("surface").agg(F.min_by("qid", F.struct((-F.col("confidence")).alias("r"), number.alias("n"))).alias("qid"))


def index_scripts(files: DataFrame) -> DataFrame:
    """(kind, path, name) of imports, classes, functions and inheritance in JavaScript and TypeScript files (path, source), by patterns."""
    patterns = {
        "IMPORTS": re.compile(r"""(?:from|import|require\()\s*['"]([^'"]+)['"]"""), "CLASS": re.compile(r"\bclass\s+(\w+)"), "INHERITS": re.compile(r"\bextends\s+(\w+)"),
        "FUNCTION": re.compile(r"\bfunction\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"),
    }

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(kind, path, next(x for x in m.groups() if x)) for path, source in zip(frame["path"], frame["source"], strict=True) for kind, p in patterns.items() for m in p.finditer(source or "")]
            yield pd.DataFrame(out, columns=["kind", "path", "name"]).drop_duplicates()

    return files.select("path", "source").mapInPandas(run, "kind string, path string, name string")


def resolve_calls(relations: DataFrame) -> DataFrame:
    """(src, dst, target) of CALLS in index_python's relations: names imported in the caller's file lead to where they are from."""
    here = F.regexp_extract("src", r"^(code::[^:]*::[^:]+)", 1)
    imported = relations.filter("kind = 'IMPORTS'").select(F.col("src").alias("file"), F.col("name").alias("local"), F.col("dst").alias("origin"))
    calls = relations.filter("kind = 'CALLS'").select("src", "dst", here.alias("file"))
    return calls.join(imported, (calls["file"] == imported["file"]) & (F.col("dst") == F.col("local")), "left").select("src", "dst", F.coalesce("origin", "dst").alias("target"))


def markdown(items: DataFrame) -> DataFrame:
    """(item_id, value): each item as a Markdown text with its fields in front."""
    head = F.concat(F.lit("---\nid: "), F.col("item_id").cast("string"), F.lit("\ntype: "), "memory_type", F.lit("\n---\n\n"))
    return items.select("item_id", F.concat(head, F.coalesce("content", F.lit("")), F.lit("\n")).alias("value"))


def stamp(rows: DataFrame, context: dict[str, str | None]) -> DataFrame:
    """rows with the scope's fields that are set."""
    return rows.withColumns({k: F.lit(v) for k, v in context.items() if v is not None})
