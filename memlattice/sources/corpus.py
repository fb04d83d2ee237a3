"""Interchange files: JSON-lines corpora with a header, source code, linearised triplets."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "content string, memory_type string, entities array<struct<name:string,type:string,qid:string>>, relations array<struct<source:string,relation:string,target:string>>, metadata map<string,string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of a corpus; its header line, malformed lines and those without content are skipped."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", RECORD).alias("r"), F.get_json_object("value", "$._type").alias("header"))
    return parsed.filter("header is null").select("r.*").filter("content is not null and content <> ''")


def write_corpus(items: DataFrame, path: str, source: str) -> DataFrame:
    """Writes items as JSON lines, and their header beside them; returns the header: count and checksum.

    The checksum doesn't depend on the order of rows: it is a digest of the sum of the rows' hashes.
    """
    lines = items.select(F.to_json(F.struct(*items.columns)).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/records")
    back = items.sparkSession.read.text(f"{path}/records")
    total = F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).cast("string")
    header = back.agg(F.lit("header").alias("_type"), F.lit(1).alias("_version"), F.lit(source).alias("_source"), F.count(F.lit(1)).alias("item_count"), F.sha2(total, 256).alias("checksum"))
    header.write.mode("overwrite").json(f"{path}/header")
    return header


def triplets(text: Column) -> Column:
    """Triplets of `<triplet> head <subj> tail <obj> relation` sequences, as structs."""
    parts = F.regexp_extract_all(text, F.lit(r"<triplet>((?:(?!<triplet>).)*)"), 1)

    def of(part: Column) -> Column:
        head = F.trim(F.regexp_extract(part, r"^([^<]*)<subj>", 1))
        pairs = F.regexp_extract_all(part, F.lit(r"<subj>([^<]*<obj>[^<]*)"), 1)
        return F.transform(pairs, lambda p: F.struct(head.alias("head"), F.trim(F.split_part(p, F.lit("<obj>"), F.lit(2))).alias("relation"), F.trim(F.split_part(p, F.lit("<obj>"), F.lit(1))).alias("tail")))

    return F.filter(F.flatten(F.transform(parts, of)), lambda x: (x["head"] != "") & (x["tail"] != "") & (x["relation"] != ""))


def index_python(files: DataFrame, repo: str) -> DataFrame:
    """(kind, src, dst, name): definitions, imports, calls and inheritance in files (path, source); broken files give nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str, str, str, str]] = []
            for path, source in zip(frame["path"], frame["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                here = f"code::{repo}::{path}"
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        me = f"{here}::{node.name}"
                        out.append(("DEFINES", here, me, node.name))
                        if isinstance(node, ast.ClassDef):
                            out += [("INHERITS", me, ast.unparse(b), node.name) for b in node.bases]
                        out += [("CALLS", me, ast.unparse(c.func), node.name) for c in ast.walk(node) if isinstance(c, ast.Call)]
                    elif isinstance(node, ast.Import):
                        out += [("IMPORTS", here, a.name, a.asname or a.name) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        out += [("IMPORTS", here, f"{node.module or ''}.{a.name}", a.asname or a.name) for a in node.names]
            yield pd.DataFrame(out, columns=["kind", "src", "dst", "name"]).drop_duplicates()

    return files.select("path", "source").mapInPandas(run, "kind string, src string, dst string, name string")
