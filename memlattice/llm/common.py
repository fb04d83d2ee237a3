"""What the corpus operators share: scratch tables in the shared folder, size-checked broadcasts, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words: space and the five ASCII controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]+"
#: Rows of at most this many narrow columns may be broadcast: about 64 MB in an executor.
BROADCAST_ROWS = 1_000_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="memlattice-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    Nothing reads the shuffles of a written table again, so their files go at once.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _shuffles_freed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """All rows appended to a table so far."""
        path = f"{self.root}/{name}"
        with _shuffles_freed(self.spark):
            df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def keep_only(self, *names: str) -> None:
        """Delete all tables but those that a result still reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            self.drop(*({x.getPath().getName() for x in fs.listStatus(root)} - set(names)))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a materialised narrow table of at most limit rows; larger ones are left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def text_key() -> list[Column]:
    """Identity of a row where doc_id may repeat or be null."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


# ---- word hashing in numpy -------------------------------------------------------------------------------------

PIECE = 1 << 21
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]  # A-Z hash as a-z
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 256), _BASE, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's words, lower-cased by A-Z only, and where they start."""
    a = np.frombuffer(raw, np.uint8)
    word = ~_IS_BLANK[a]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _BYTES[a[word]] * _powers_to(int(size.max()))[at]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        cut = re.compile(rb"[\x20\x09-\x0D]").search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def hash_words(raw: bytes) -> np.ndarray:
    """Word hashes of one text, in pieces of about 2 MB so that long texts need little memory."""
    parts = [_hash_piece(x)[0] for x in _pieces(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def hash_batch(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, word hashes, offsets of each text in them) for runs of texts of about 2 MB."""
    at = 0
    while at < len(texts):
        end, room = at, PIECE
        while end < len(texts) and (end == at or room > 0):
            room -= len(texts[end] or b"") + 1
            end += 1
        run = [x or b"" for x in texts[at:end]]
        if len(run) == 1:
            words = hash_words(run[0])
            yield at, end, words, np.array([0, len(words)])
        else:
            words, starts = _hash_piece(b"\n".join(run))
            bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in run])))
            yield at, end, words, np.searchsorted(starts, bounds)
        at = end


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct sorted hashes of a text's shingles; fewer words than width make one shingle."""
    if not len(words):
        return words
    width_now = min(width, len(words))
    n = len(words) - width_now + 1
    out = np.full(n, width_now, np.uint64)
    for k in range(width_now):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return np.unique(mix(out))


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's UTF-8 without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


# ---- byte spans of words in Arrow buffers ----------------------------------------------------------------------

#: Bytes looked at together, so that working memory does not grow with a batch or a text.
BLOCK = 1 << 21
#: Word bytes of `[^\x20\x09-\x0D]+`, and of letters, digits and everything above ASCII.
NOT_BLANK_BYTES = ~_IS_BLANK
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[97:123] = ALNUM_BYTES[65:91] = ALNUM_BYTES[128:] = True
CASED, FOLDED = mix(np.arange(256, dtype=np.uint64)), _BYTES


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its row bounds in them, without a copy of the texts; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def word_spans(a: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all rows of a buffer, and each row's first word (with one entry more)."""
    starts, ends = [], []
    for low in range(int(bounds[0]), int(bounds[-1]), BLOCK):
        high = min(low + BLOCK, int(bounds[-1]))
        word = is_word[a[low:high]]
        # a word begins after a blank or at its row's border, and ends likewise
        inner = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low
        before = np.concatenate(([low > bounds[0] and is_word[a[low - 1]]], word[:-1]))
        before[inner] = False
        starts.append(np.flatnonzero(word & ~before) + low)
        after = np.concatenate((word[1:], [high < bounds[-1] and is_word[a[high]]]))
        closing = bounds[np.searchsorted(bounds, low, "right") : np.searchsorted(bounds, high, "right")] - low - 1
        after[closing[closing >= 0]] = False
        ends.append(np.flatnonzero(word & ~after) + low + 1)
    none = np.zeros(0, np.int64)
    starts, ends = np.concatenate(starts or [none]), np.concatenate(ends or [none])
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the words between starts and ends by a table of byte values."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    done = np.concatenate(([0], np.cumsum(size)))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(done, done[low] + BLOCK, "right")) - 1)
        n = size[low:high]
        first = done[low:high] - done[low]
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        values = table[a[np.repeat(starts[low:high], n) + at]] * _powers_to(int(n.max()))[at]
        out[low:high] = mix(np.add.reduceat(values, first) + n.astype(np.uint64))
        low = high
    return out
