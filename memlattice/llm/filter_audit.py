"""Filter interaction audit: what each of five text filters removes after, before and without the others."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, CASED, NOT_BLANK_BYTES, Scratch, buffers, hash_spans, word_spans

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
_BIT = {x: 1 << k for k, x in enumerate(FILTERS)}
_MASKS = 1 << len(FILTERS)
_CAPITAL, _SYMBOL, _LEADS = (np.zeros(256, bool) for _ in range(3))
_CAPITAL[65:91] = _SYMBOL[list(SYMBOLS)] = True
_LEADS[:128] = _LEADS[192:] = True  # bytes that begin a code point
#: Words whose hashes are sorted together, unless one text has more.
_WORDS = 1 << 18


def class_counts(a: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(3, rows): code points, capitals and symbols of each row, from prefix sums over blocks of the buffer."""
    out = np.zeros((3, len(bounds) - 1), np.int64)
    for low in range(int(bounds[0]), int(bounds[-1]), BLOCK):
        block = a[low : min(low + BLOCK, int(bounds[-1]))]
        inside = np.clip(bounds - low, 0, len(block))
        for k, kind in enumerate((_LEADS, _CAPITAL, _SYMBOL)):
            upto = np.concatenate(([0], np.cumsum(kind[block], dtype=np.int32)))
            out[k] += np.diff(upto[inside])
    return out


def _same_bytes(a: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a's `size` bytes at x and at y agree."""
    out = np.ones(len(x), bool)
    done = np.concatenate(([0], np.cumsum(size)))
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(done, done[low] + BLOCK, "right")) - 1)
        n, first = size[low:high], done[low:high] - done[low]
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        same = a[np.repeat(x[low:high], n) + at] == a[np.repeat(y[low:high], n) + at]
        out[low:high] = np.logical_and.reduceat(same, first)
        low = high
    return out


def distinct_words(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct words of each row: equal neighbours among its sorted hashes, verified byte by byte.

    A row in which two different words share a hash is counted by the words themselves.
    """
    hashes = hash_spans(a, starts, ends, CASED)
    out = np.diff(first)
    row = 0
    while row < len(out):
        end = max(row + 1, int(np.searchsorted(first, first[row] + _WORDS, "right")) - 1)
        words = slice(int(first[row]), int(first[end]))
        s, size, h = starts[words], ends[words] - starts[words], hashes[words]
        of = np.repeat(np.arange(row, end), out[row:end])
        order = np.lexsort((h, of))
        x, y = order[:-1], order[1:]
        equal = (of[x] == of[y]) & (h[x] == h[y])
        x, y = x[equal], y[equal]
        sure = size[x] == size[y]
        sure[sure] = _same_bytes(a, s[x[sure]], s[y[sure]], size[x[sure]])
        clashes = np.unique(of[x[~sure]])
        out[row:end] -= np.bincount(of[x] - row, minlength=end - row)
        for r in clashes:
            out[r] = len({a[b:e].tobytes() for b, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)})
        row = end
    return out


def fail_masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    a, bounds = buffers(column)
    points, capitals, symbols = class_counts(a, bounds)
    starts, ends, first = word_spans(a, bounds, NOT_BLANK_BYTES)
    words, distinct = np.diff(first), distinct_words(a, starts, ends, first)
    fails = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum((f.astype(np.int32) << k for k, f in enumerate(fails)), np.zeros(len(words), np.int32))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("part"), batch.column("same"), pa.array(fail_masks(batch.column("text")), pa.int32())], names=["doc_id", "part", "same", "mask"])


def document_masks(docs: DataFrame, part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, part, mask, n): the filters that rows fail, E included, and how many rows those are.

    E goes by the SHA-256 of the text.  The least doc_id of each text is an aggregate, joined back by text and doc_id
    together, so that a text of very many copies is no hot key; rows that repeat a doc_id are added up before.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same"), "text")
    scanned = rows.mapInArrow(_scan, "doc_id long, part string, same binary, mask int")
    facts = scratch.save(scanned.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n")), "facts")
    known = facts.filter("doc_id is not null")
    least = known.groupBy("same").agg(F.min("doc_id").alias("least"))
    first = least.select(F.col("same").alias("f_same"), F.col("least").alias("f_doc"))
    joined = known.join(first, (F.col("same") == F.col("f_same")) & (F.col("doc_id") == F.col("f_doc")), "left")
    marked = joined.select("doc_id", "part", F.when(F.col("f_doc").isNull(), F.col("mask").bitwiseOR(F.lit(_BIT["E"]))).otherwise(F.col("mask")).alias("mask"), "n")
    return marked.union(facts.filter("doc_id is null").select("doc_id", "part", "mask", "n"))


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of FILTERS; for each order and step the mask of the filters before, and of the step's own."""
    names = ["".join(p) for p in permutations(FILTERS)]
    own = np.array([[_BIT[x] for x in p] for p in names])
    return names, np.cumsum(own, axis=1) - own, own


def audit_counts(cube: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all orders and steps, from (parts, masks, 3) numbers of documents, good ones and toxic ones."""
    names, before, own = _orders()
    mask = np.arange(_MASKS)
    earlier, fails = (mask[:, None, None] & before) != 0, (mask[:, None, None] & own) != 0
    total = lambda rows, k: np.tensordot(cube[:, :, k], rows.astype(np.int64), 1)
    here = fails & ~earlier
    out = {"kept": total(~earlier & ~fails, 0), "removed": total(here, 0), "redundant": total(fails & earlier, 0), "unique_fails": total(mask[:, None, None] == own, 0), "good_lost": total(here, 1), "toxic_lost": total(here, 2)}
    by_filter = np.stack([(out["removed"] * (own == _BIT[x])).sum(axis=(1, 2)) for x in FILTERS], axis=1)
    out["shapley"] = by_filter[:, np.log2(own).astype(int)]
    return out


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _orders()[0]
    for batch in batches:
        for low in range(0, batch.num_rows, 100):
            some = batch.slice(low, 100)
            cube = np.zeros((some.num_rows, _MASKS, 3), np.int64)
            for k, cells in enumerate(some.column("cells").to_pylist()):
                for cell in cells:
                    cube[k, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            n, counts = len(names) * len(FILTERS), audit_counts(cube)
            part = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), n)))
            order = pa.array(names * some.num_rows).take(pa.array(np.repeat(np.arange(len(names) * some.num_rows), len(FILTERS))))
            step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(names) * some.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(counts[x].ravel()) for x in _COUNTS)], names=["part", "filter_order", "step", *_COUNTS])


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What five filters remove, in every order: (part, filter_order, step, counts), 600 rows for each value of `part`.

    A text fails A with under 50 words, B if under 65 % of its words are distinct, C if over 5 % of its code points are
    capitals, D if it holds a symbol, E if a smaller doc_id has the same text anywhere.  Texts are scanned in Arrow's
    buffers, blocks of 2 MB at a time; what follows are counts by mask of failed filters, which the orders sum up.

    Null and empty texts are the same empty text: they fail A only (and E).  A null doc_id is no copy's original, fails
    no E and has no labels; rows that repeat a doc_id with the same text don't make each other fail.  A doc_id is good
    or toxic if any of its labels says so.  A null part is the empty string; a very long text is one text, of which a
    task holds about three times its bytes; no documents give no rows.  Other columns are ignored.
    """
    masks = document_masks(docs, part)
    flag = lambda c: F.max((F.col(c) == 1).cast("long"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    labelled = masks.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("l_doc"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    labelled = labelled.union(masks.filter("doc_id is null").select("part", "mask", "n", F.lit(0), F.lit(0)))
    cells = labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return audit_filters(docs.select("doc_id", "source", "text"), labels)


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), fails AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM texts
), known AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(k.good), 0) AS good, coalesce(sum(k.toxic), 0) AS toxic FROM fails f LEFT JOIN known k ON f.doc_id = k.doc_id GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)
), steps AS (
  SELECT o.filter_order, s.step::INT AS step, o.bits[s.step] AS own, coalesce(list_sum(o.bits[1:s.step - 1]), 0)::INT AS earlier
  FROM (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5) o,
       (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
