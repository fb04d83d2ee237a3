"""Line dedup: range-partitioned line hashes, a sorted stream over them, and a keep bitmap for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, broadcast_if_small, text_key

_STRIP = " \t\n\x0b\x0c\r"
#: Line positions in one word of a bitmap.
_BITS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_STRIP)))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_key: int = 1, keep_first: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (doc_id, text_hash, n_dropped, keep array<struct<at,bits>>).

    A line whose key (stripped, A-Z lower-cased) has min_key code points or more and stands in min_docs documents or
    more is dropped everywhere, or, with keep_first, everywhere but at its first place by (doc_id, position).  The
    bitmap is compressed: bit p % 32 of the word at p // 32 is set for a line p that stays; words that keep all their
    lines are left out, as are documents that do.

    Hashes are range-partitioned together with document, so that a very common line spreads over several ranges, and
    sorted by document and position; a stream over each sorted range marks where a document first has a line.  Those
    marks, which no later reading of the table in other parts can change, are summed.

    A document is a doc_id: rows that repeat one count once, whatever their texts, and lose lines each by itself.  Rows
    with null doc_id lose lines too, but count for no line, and sort first.  Null or empty texts have one empty line.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    line = docs.select(*text_key(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    line = line.select("doc_id", "text_hash", "pos", _key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    hashed = line.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")
    sorted_rows = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    ranges = scratch.save(sorted_rows.mapInArrow(_mark_firsts, _RANGE), "ranges")
    seen = ranges.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("opens").alias("n_docs"), *([F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")] if keep_first else []))
    common = scratch.save(seen.filter(F.col("n_docs") >= min_docs), "common")
    dropped = _rows_of(ranges.drop("opens"), common)
    if keep_first:
        dropped = dropped.filter(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % _BITS).cast("int"))
    word = dropped.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / _BITS).cast("int").alias("at")).agg(F.bit_or(bit).alias("gone"))
    word = word.select("doc_id", "text_hash", "at", F.bit_count("gone").alias("n"), F.bitwise_not("gone").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("bits"))
    return word.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("keep"))


#: Lines of more than this share of all common rows are at most as many as its inverse.
_HOT = 1e-5


def _rows_of(ranges: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of ranges whose line is in common, a materialised table of lines and their numbers of rows.

    Common lines are broadcast while they are few.  Beyond that only those are which hold more than the share _HOT of
    the rows, 1 / _HOT at most, so that their rows stay where they are; the other lines are joined by a shuffle.
    """
    small = broadcast_if_small(common)
    if small is not common:
        return ranges.join(small.drop("n_rows", "n_docs"), ["h1", "h2"])
    least = common.select(F.sum("n_rows") * F.lit(_HOT)).first()[0]
    lines = common.drop("n_rows", "n_docs")
    hot = F.broadcast(lines.filter(common["n_rows"] > least))
    cold = ranges.join(F.broadcast(common.filter(common["n_rows"] > least).select("h1", "h2")), ["h1", "h2"], "left_anti")
    return ranges.join(hot, ["h1", "h2"]).unionByName(cold.join(lines.filter(common["n_rows"] <= least), ["h1", "h2"]))


_RANGE = "h1 long, h2 long, doc_id long, text_hash long, pos int, opens boolean"


def _mark_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, in one range's sorted rows of (line, document, position), each known document's first row of each line.

    All rows of a line and document are in one range, which one task streams.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        keys = [batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)]
        opens = np.ones(batch.num_rows, bool)
        opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        opens[0] = tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(opens & keys[3])], names=[*batch.schema.names, "opens"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of docs as a struct, and the lines that stay, joined by a newline."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("text_hash"))
    maps = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("text_hash").alias("b_text"), F.col("n_dropped").alias("b_n"), F.map_from_entries("keep").alias("b_keep"))
    joined = rows.join(maps.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("b_doc")) & (F.col("text_hash") == F.col("b_text")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    bit = lambda p: F.coalesce(F.try_element_at("b_keep", F.floor(p / _BITS).cast("int")), F.lit(-1).cast("long"))
    stays = lambda x, p: F.getbit(bit(p), (p % _BITS).cast("int")) == 1
    kept = F.when(F.col("b_n").isNull(), text).otherwise(F.array_join(F.filter(_lines(F.col("row.text")), stays), "\n"))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), F.coalesce("b_n", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with the text that remains, and n_chars counted anew where that column exists; null texts stay null."""
    out = apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_key, keep_first))
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    new = {"text": text} | ({"n_chars": F.when(text.isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, line_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, list_extract(d.parts, u.pos) AS line,
         translate(trim(list_extract(d.parts, u.pos), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS pos) u
), common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
