"""Spelling variants: tries of the vocabulary in shards, searched by each word's distance-one automaton."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: One byte a code point: the letters of Latin-1 after A-Z are lower-cased.
TYPO_EVERY, MIN_LENGTH, MIN_COUNT, FACTOR = 31, 7, 2, 10
#: Whole runs; shorter ones can't become words, as typos only take letters away.
_RUN = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % MIN_LENGTH)
#: Words of a task that are counted before they are handed on.
_HELD = 1 << 17
#: Most words, and most letters (but for one word that has more), of a trie shard.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 20
#: Bytes of shards that are broadcast together.
BROADCAST_BYTES = 1 << 26
#: Words searched together, and states that are followed together.
_WORDS, _STATES = 1 << 12, 1 << 16


# ---- words ------------------------------------------------------------------------------------------------------


def document_words(doc_id: int | None, text: str | None) -> Counter[bytes]:
    """The words of a text with their typos: where crc32 of `<doc_id>:<run>` is a multiple of TYPO_EVERY, one letter goes.

    Only words of MIN_LENGTH code points count.  A null doc_id has no typos.
    """
    runs = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    if doc_id is None:
        return runs
    prefix, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % TYPO_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text"), strict=True):
            for word, n in document_words(doc_id, text.as_py()).items():
                held[word] += n
            if len(held) >= _HELD:
                yield handed()
                held.clear()
    yield handed()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with MIN_LENGTH code points and MIN_COUNT occurrences; each task adds up before it shuffles."""
    return docs.select("doc_id", "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---- tries ------------------------------------------------------------------------------------------------------


class Trie:
    """Nodes in order of depth and path; a node's key is its parent * 256 + its letter, so keys ascend.

    keys[i] belongs to node i + 1; node 0 is the root.  word[node] is the index of the word that ends there, or -1.
    """

    def __init__(self, keys: np.ndarray, word: np.ndarray):
        self.keys, self.word = keys, word

    @staticmethod
    def of(words: list[bytes]) -> Trie:
        """The trie of sorted distinct words."""
        letters, bounds = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        size = np.diff(bounds)
        alive, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        keys, ends, depth, nodes = [], [(0, k) for k in np.flatnonzero(size == 0)], 0, 1
        while len(alive := alive[size[alive] > depth]):
            key = node[alive] * 256 + letters[bounds[alive] + depth]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            node[alive] = nodes - 1 + np.cumsum(new)
            keys.append(key[new])
            nodes, depth = nodes + int(new.sum()), depth + 1
            done = alive[size[alive] == depth]
            ends += zip(node[done].tolist(), done.tolist(), strict=True)
        word = np.full(nodes, -1, np.int32)
        if ends:
            at, which = zip(*ends, strict=True)
            word[list(at)] = which
        return Trie(np.concatenate(keys) if keys else np.zeros(0, np.int64), word)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Each node's child by a letter, or -1."""
        key = node * 256 + letter
        at = np.searchsorted(self.keys, key)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] == key[found]
        return np.where(found, at + 1, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into node, child) of all children."""
        low, high = np.searchsorted(self.keys, node * 256), np.searchsorted(self.keys, node * 256 + 256)
        n = high - low
        of = np.repeat(np.arange(len(node)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of] + 1


def near_words(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index into words, index of a word in the trie) of all pairs at a distance of exactly one.

    A word's automaton has no error on the word's own path, and one error off it or behind a skipped letter; a state is
    (word, node, letters read).  Blocks of states are intersected with the trie depth-first from a stack.  From a node
    on the path, an inserted or replaced letter leads to every other child and a skipped one off the path by the next
    letter; what would come back to the path is left to the later nodes there, so no state is reached twice.
    """
    letters, size = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.array([len(w) for w in words], np.int64)
    bounds = np.cumsum(size) - size
    at = lambda w, pos: letters[np.minimum(bounds[w] + pos, len(letters) - 1)].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(True, np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))]

    def push(exact: bool, w: np.ndarray, node: np.ndarray, pos: np.ndarray) -> None:
        if len(w):
            stack.append((exact, w, node, pos))

    def accept(w: np.ndarray, node: np.ndarray) -> None:
        ends = trie.word[node] >= 0
        if ends.any():
            found.append((w[ends], trie.word[node[ends]].astype(np.int64)))

    while stack:
        exact, w, node, pos = stack.pop()
        if len(w) > _STATES:
            push(exact, w[_STATES:], node[_STATES:], pos[_STATES:])
            w, node, pos = w[:_STATES], node[:_STATES], pos[:_STATES]
        left = size[w] - pos
        if not exact:  # one error made: the rest must follow
            accept(w[left == 0], node[left == 0])
            go = left > 0
            w, node, pos = w[go], node[go], pos[go]
            down = trie.child(node, at(w, pos))
            push(False, w[down >= 0], down[down >= 0], pos[down >= 0] + 1)
            continue
        accept(w[left == 1], node[left == 1])  # the last letter skipped
        skip = np.flatnonzero((left > 1) & (at(w, pos) != at(w, pos + 1)))
        down = trie.child(node[skip], at(w[skip], pos[skip] + 1))
        push(False, w[skip[down >= 0]], down[down >= 0], pos[skip[down >= 0]] + 2)
        of, child = trie.children(node)
        own = (left[of] > 0) & (trie.keys[child - 1] % 256 == at(w[of], pos[of]))
        off, on = of[~own], of[own]
        push(False, w[off], child[~own], pos[off])  # a letter inserted
        replaced = left[off] > 0
        push(False, w[off[replaced]], child[~own][replaced], pos[off[replaced]] + 1)
        push(True, w[on], child[own], pos[on] + 1)
    none = np.zeros(0, np.int64)
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (none, none)


_SHARD = "shard long, least int, most int, size long, keys binary, word binary, words binary, counts binary"


def _shard(words: list[bytes], counts: list[int], number: int) -> pa.RecordBatch:
    trie = Trie.of(words)
    blobs = [trie.keys.tobytes(), trie.word.tobytes(), b"\n".join(words), np.array(counts, np.int64).tobytes()]
    sizes = [len(w) for w in words]
    row = [number, min(sizes), max(sizes), sum(map(len, blobs)), *blobs]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "least", "most", "size", "keys", "word", "words", "counts"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's sorted words, cut before they have more than SHARD_WORDS or SHARD_LETTERS."""
    number = TaskContext.get().partitionId() << 32
    words, counts, room = [], [], SHARD_LETTERS
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            word = word.encode("latin-1")
            if words and (len(words) == SHARD_WORDS or len(word) > room):
                yield _shard(words, counts, number)
                words, counts, room, number = [], [], SHARD_LETTERS, number + 1
            words.append(word)
            counts.append(n)
            room -= len(word)
    if words:
        yield _shard(words, counts, number)


def build_shards(words: DataFrame, parts: int) -> DataFrame:
    """Trie shards of ranges of words: one task reads one range, and cuts it, so a shard's size never depends on the corpus."""
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_build, _SHARD)


def _searcher(shards: list[tuple]):
    """shards: (least, most, keys, word, words, counts) in a broadcast value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple] = []
        for least, most, keys, word, words, counts in shards.value:
            opened.append((least, most, Trie(np.frombuffer(keys, np.int64), np.frombuffer(word, np.int32)), pa.array(words.decode("latin-1").split("\n"), pa.string()), pa.array(np.frombuffer(counts, np.int64))))
        for batch in batches:
            for low in range(0, batch.num_rows, _WORDS):
                some = batch.column("word").slice(low, _WORDS)
                raw = [w.encode("latin-1") for w in some.to_pylist()]
                size = np.array([len(w) for w in raw])
                for least, most, trie, words, counts in opened:
                    fits = np.flatnonzero((size >= least - 1) & (size <= most + 1))
                    w, near = near_words(trie, [raw[k] for k in fits])
                    if len(w):
                        at = pa.array(near)
                        yield pa.RecordBatch.from_arrays([some.take(pa.array(fits[w])), words.take(at), counts.take(at)], names=["word", "near", "near_n"])

    return run


def neighbours(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): all pairs of different words of a materialised (word, n) that one edit parts.

    Shards are broadcast in groups of BROADCAST_BYTES at most (or one shard); each group meets all words of lengths that
    can be near its own.  Only the shards' sizes reach the driver together.
    """
    spark = words.sparkSession
    n = words.count()
    shards = scratch.save(build_shards(words, -(-n // SHARD_WORDS) or 1), "shards")
    dealt = scratch.save(words.repartition(max(spark.sparkContext.defaultParallelism, -(-n // (1 << 14)))), "dealt")
    groups: list[list] = []
    room = 0
    for row in shards.select("shard", "least", "most", "size").orderBy("shard").collect():
        if not groups or row["size"] > room:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(row)
        room -= row["size"]
    out = scratch.append(spark.createDataFrame([], "word string, near string, near_n long"), "near")
    for group in groups:
        blobs = shards.filter(F.col("shard").isin([r["shard"] for r in group])).select("least", "most", "keys", "word", "words", "counts").collect()
        shared = spark.sparkContext.broadcast([(r[0], r[1], *map(bytes, r[2:])) for r in blobs])
        fit = F.length("word").between(min(r["least"] for r in group) - 1, max(r["most"] for r in group) + 1)
        out = scratch.append(dealt.filter(fit).mapInArrow(_searcher(shared), "word string, near string, near_n long"), "near")
        shared.unpersist(blocking=True)
    scratch.drop("shards", "dealt")
    return out


# ---- forms ------------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of all words that have a form.  A form is FACTOR times as frequent, so chains have under 20 steps,
    and each round of following two pointers at once halves them."""
    now, k = forms.select("word", F.col("form").alias("root")), 0
    while True:
        now = scratch.save(now, f"roots-{k}")
        later = now.select(F.col("word").alias("l_word"), F.col("root").alias("l_root"))
        step = now.join(later, now["root"] == later["l_word"], "left")
        if k and step.filter("l_root is not null").limit(1).count() == 0:
            return now
        now, k = step.select("word", F.coalesce("l_root", "root").alias("root")), k + 1


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words, the near word that each is most likely a variant of, and where that leads: (word, form, root, n, n_near, form_n).

    Words are runs of Latin letters (A-Z lower-cased, no other letters are) with planted typos, see document_words.  Two
    are near if one inserted, deleted or replaced code point makes one the other.  A word's form is its most frequent
    near word (ties: the smallest), if that is FACTOR times as frequent; root follows forms to the last.

    Null and empty texts have no words; a null doc_id has words but no typos; repeated rows count again; a very long text
    or word is taken whole (a word of more letters than a shard is a shard of its own); no documents give no rows; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(count_words(docs), "words")
    near = neighbours(words, scratch)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    reduced = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(reduced.select(F.col("word").alias("r_word"), "n_near", "best"), F.col("word") == F.col("r_word"), "left")
    holds = -F.col("best.less") >= FACTOR * F.col("n")
    formed = scratch.save(joined.select("word", F.when(holds, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, -F.col("best.less")).alias("form_n")), "formed")
    roots = _roots(formed.filter("form is not null").select("word", "form"), scratch).select(F.col("word").alias("r_word"), F.col("root"))
    return formed.join(broadcast_if_small(roots), F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS code FROM runs GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, n, list_transform(range(1, length(code), 2), lambda i: ('0x' || substr(code, i::BIGINT, 2))::BIGINT) AS b FROM counted
), hashed AS (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, bits
), edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), formed AS (
  SELECT w.word, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NOT NULL
), last AS (
  SELECT w.word, w.at AS root FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN last l ON f.word = l.word
"""
