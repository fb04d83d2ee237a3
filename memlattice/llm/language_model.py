"""Language-model scores by a weighted backoff automaton over smoothed n-grams, cut to what each block of texts can reach.

The automaton's states are the n-grams seen in training; a state's arc on a token weighs (count + BETA * shorter) / (total +
BETA), and its failure arc, to the state that forgets the oldest token, weighs BETA / (total + BETA).  No machine holds
it whole: a block of texts asks shards of the counts for the n-grams that it contains and gets their totals back in the
order it asked in.  From those it builds the states and arcs that a stretch of its texts can reach, and one traversal,
left to right, carries each text's state over them and adds up the weights of the arcs it takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binaries, hash_batch, mix, remainder

#: Tokens of the longest n-grams, and the pseudo-counts of the shorter history by order (from the second on).
ORDER, BETA = 3, (512.0, 8.0)
#: Tokens of a block: what one task counts and walks at once.
BLOCK = 1 << 21
#: Bytes of text whose n-grams make one shard of the counts.
SHARD = 1 << 22
#: Tokens of the texts that share an automaton, and of one walk.
_STRETCH, _WALK = 1 << 16, 1 << 8
END = int(mix(np.array([0xE2D], np.uint64)).view(np.int64)[0])
FOLDS, HELD_OUT = 5, 1
_STEP = np.uint64(0x2545F4914F6CDD1D)


def pack(x: np.ndarray) -> bytes:
    """An array as compressed bytes, equal places of its items together."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""
    item = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(item, -1).T.copy().view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


class Block:
    """Tokens of pieces of texts.  Each piece starts with `skip` tokens of history that are walked elsewhere."""

    def __init__(self, words: np.ndarray, code: np.ndarray, size: np.ndarray, skip: np.ndarray, held_out: np.ndarray):
        token = words[code]
        self.token, self.code, self.size, self.skip = token, code, size, skip
        self.start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.place = np.arange(len(token), dtype=np.int32) - np.repeat(self.start.astype(np.int32), size)
        self.walked = self.place >= np.repeat(skip.astype(np.int32), size)
        self.trained = self.walked & ~np.repeat(held_out, size)

    def n_grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the hash of the n-gram that ends at each token, and whether the piece is long enough for it."""
        key = self.token.view(np.uint64)
        for order in range(1, ORDER + 1):
            if order > 1:
                key = mix(np.concatenate((key[:1], key[:-1])) * _STEP + self.token.view(np.uint64))
            yield key, self.place >= order - 1

    def walk(self, counts: list[np.ndarray], total: int, distinct: int) -> tuple[np.ndarray, ...]:
        """For each piece: tokens, known ones, failure arcs taken, log10 base and score.

        counts: of each order, the training count of the n-gram that ends at each token (0 where there is none).  Pieces
        are cut into walks of _WALK tokens, each of which reads the history before it first; an automaton is built for
        some walks at a time, so that little memory is held beside the counts.
        """
        begin = self.start + self.skip
        n = -(-(self.size - self.skip) // _WALK)
        of = np.repeat(np.arange(len(n)), n)
        first = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * _WALK
        end = np.minimum(first + _WALK, (self.start + self.size)[of])
        warm = np.minimum(ORDER - 1, first - self.start[of])
        failed, base, score, known = np.zeros(len(of), np.int64), np.zeros(len(of)), np.zeros(len(of)), np.zeros(len(of), np.int64)
        at = 0
        while at < len(of):
            upto = max(at + 1, int(np.searchsorted(first, first[at] + _STRETCH)))
            low, high = int(first[at] - warm[at]), int(end[upto - 1])
            piece, some = slice(low, high), slice(at, upto)
            machine = Automaton(self.code[piece], self.place[piece], [c[piece] for c in counts], total, distinct)
            score[some], failed[some] = machine.walk(first[some] - low, end[some] - low, warm[some])
            one = np.log10((counts[0][piece] + 0.5) / (total + 0.5 * (distinct + 1)))
            sums = lambda x: np.concatenate(([0], np.cumsum(x)))
            for out, x in ((base, sums(one)), (known, sums(counts[0][piece] > 0))):
                out[some] = x[end[some] - low] - x[first[some] - low]
            at = upto
        whole = lambda x: np.add.reduceat(x, np.cumsum(n) - n)
        return self.size - self.skip, whole(known), whole(failed), whole(base), whole(score)


class Automaton:
    """The part of the backoff automaton that a stretch of tokens can reach.

    State 0 is the empty history, the others are the n-grams of fewer than ORDER tokens that training has.  Arcs are
    sorted by state * codes + code; state 0 has one on every code.  A state without an arc on a code goes to fail_to, for
    fail_weight, and tries again there.  Weights are log10.
    """

    def __init__(self, code: np.ndarray, place: np.ndarray, counts: list[np.ndarray], total: int, distinct: int):
        _, some, self.code = np.unique(code, return_index=True, return_inverse=True)
        self.codes = n = len(some)
        seen = counts[0][some]
        p = (seen + 0.5) / (total + 0.5 * (distinct + 1))
        name = np.arange(1, n + 1)
        keys, weights, dests = [np.arange(n)], [np.log10(p)], [np.where(seen > 0, name, 0)]
        fail_to, fail_weight = [np.zeros(n + 1, np.int64)], [np.concatenate(([0.0], _log_share(BETA[0], seen)))]
        states, state, p = n + 1, np.where(counts[0] > 0, name[self.code], 0), p[self.code]
        for order in range(2, ORDER + 1):
            before = np.concatenate(([0], state[:-1]))
            there = np.flatnonzero((place >= order - 1) & (before > 0) & (counts[order - 1] > 0))
            key, some, arc = np.unique(before[there] * n + self.code[there], return_index=True, return_inverse=True)
            at = there[some]
            beta, count = BETA[order - 2], counts[order - 1][at]
            shorter = (count + beta * p[at]) / (counts[order - 2][at - 1] + beta)
            keys.append(key)
            weights.append(np.log10(shorter))
            if order < ORDER:
                name = states + np.arange(len(key))
                dests.append(name)
                fail_to.append(state[at])
                fail_weight.append(_log_share(BETA[order - 1], count))
                p, longer = p.copy(), np.zeros(len(state), np.int64)
                p[there], longer[there] = shorter[arc], name[arc]
                states, state = states + len(key), longer
            else:
                dests.append(state[at])
        self.key, self.weight, self.dest = (np.concatenate(x) for x in (keys, weights, dests))
        self.fail_to, self.fail_weight = np.concatenate(fail_to), np.concatenate(fail_weight)

    def walk(self, first: np.ndarray, end: np.ndarray, warm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, failure arcs) of the tokens from each first to its end, after a history of warm tokens.

        All walks go left to right together, a token a step, each with its own state; those that have ended drop out.
        """
        order = np.argsort(first - warm - end, kind="stable")
        start, steps, warm = (first - warm)[order], (end - first + warm)[order], warm[order]
        state = np.zeros(len(order), np.int64)
        score, failed = np.zeros(len(order)), np.zeros(len(order), np.int64)
        active = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
        for step, m in enumerate(active.tolist()):
            code, counted = self.code[start[:m] + step], step >= warm[:m]
            now = state[:m].copy()
            key = now * self.codes + code
            at = np.searchsorted(self.key, key)
            missing = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != key)
            while len(missing):  # failure arcs, down to a state that knows the token
                score[missing] += np.where(counted[missing], self.fail_weight[now[missing]], 0.0)
                failed[missing] += counted[missing]
                now[missing] = self.fail_to[now[missing]]
                key = now[missing] * self.codes + code[missing]
                at[missing] = found = np.searchsorted(self.key, key)
                missing = missing[self.key[np.minimum(found, len(self.key) - 1)] != key]
            score[:m] += np.where(counted, self.weight[at], 0.0)
            state[:m] = self.dest[at]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return score[back], failed[back]


def _log_share(beta: float, count: np.ndarray) -> np.ndarray:
    return np.log10(beta / (count + beta))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, keys, starts): the order that sorts the keys, the distinct ones, and where each starts in that order."""
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order, ranked[starts], starts


_BLOCKS = "block long, row array<long>, doc_id array<long>, held_out array<boolean>, part array<int>, parts array<int>, size array<int>, skip array<int>, words binary, codes binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to blocks of about BLOCK tokens; longer texts are cut into pieces."""
    block = row = TaskContext.get().partitionId() << 33
    pieces: list[tuple] = []
    tokens: list[np.ndarray] = []
    room = BLOCK

    def give() -> pa.RecordBatch:
        words, code = np.unique(np.concatenate(tokens), return_inverse=True)
        rank = np.argsort(-np.bincount(code), kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        columns = [[x] for x in zip(*pieces, strict=True)]
        values = [pa.array(x, kind) for x, kind in zip(columns, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *values, pa.array([pack(words[rank])], pa.binary()), pa.array([pack(place[code])], pa.binary())], names=_NAMES)

    for batch in batches:
        ids, held, texts = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), binaries(batch.column("text"))
        for at, end, words, bounds in hash_batch(texts):
            for k in range(end - at):
                token = np.concatenate(([END], words[bounds[k] : bounds[k + 1]].view(np.int64), [END]))
                cuts = list(range(1, len(token), BLOCK))
                for part, first in enumerate(cuts):
                    skip = min(first, ORDER - 1)
                    piece = token[first - skip : first + BLOCK]
                    pieces.append((row, ids[at + k], held[at + k], part, len(cuts), len(piece), skip))
                    tokens.append(piece)
                    room -= len(piece)
                    if room <= 0:
                        yield give()
                        block, room = block + 1, BLOCK
                        pieces.clear()
                        tokens.clear()
                row += 1
    if pieces:
        yield give()


_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]
_KINDS = [pa.list_(x) for x in (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]


def _read_block(size: list[int], skip: list[int], held_out: list[bool], words: bytes, codes: bytes) -> Block:
    return Block(unpack(words, np.int64), unpack(codes, np.int32), np.array(size), np.array(skip), np.array(held_out))


def _ask(shards: int, order: int) -> Callable:
    """Blocks to (shard, block, keys, n): distinct n-grams of order + 1 tokens, sorted, and how often each occurs in training texts."""
    edges = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                block = _read_block(x["size"], x["skip"], x["held_out"], x["words"], x["codes"])
                key, there = next(islice(block.n_grams(), order, None))
                if not there.any():
                    continue
                rank, keys, starts = _distinct(key[there])
                n = np.add.reduceat(block.trained[there][rank], starts, dtype=np.uint32)
                bounds = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
                out = [(s * ORDER + order, x["block"], pack_sorted(keys[a:b]), pack(n[a:b])) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
                shard, name, keys, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(name, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], names=["shard", "block", "keys", "n"])

    return run


def _sum_shard(asked: pa.Table) -> pa.Table:
    """One shard's questions to (shard, block, totals), totals in the order of the keys asked for, and a row of its sums."""
    keys = [unpack_sorted(x) for x in asked.column("keys").to_pylist()]
    n = [unpack(x, np.uint32) for x in asked.column("n").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.int64)
    parts = np.split(sums[place], np.cumsum([len(k) for k in keys])[:-1])
    rows = len(parts) + 1
    shard = asked.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * rows, pa.int64()),
        "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()),
        "totals": pa.array([*map(pack, parts), None], pa.binary()),
        "total": pa.array([0] * (rows - 1) + [int(sums.sum())], pa.int64()),
        "distinct": pa.array([0] * (rows - 1) + [int((sums > 0).sum())], pa.int64()),
    })


_SCORED = "row long, part int, parts int, doc_id long, held_out boolean, n_tokens long, n_known long, n_failed long, base double, score double"


def _walk(total: int, distinct: int) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        x = blocks.to_pylist()[0]
        block = _read_block(x["size"], x["skip"], x["held_out"], x["words"], x["codes"])
        by_shard = sorted(zip(answers.column("shard").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        counts = []
        for order, (key, there) in enumerate(block.n_grams()):
            totals = np.concatenate([unpack(t, np.int64) for s, t in by_shard if s % ORDER == order] or [np.zeros(0, np.int64)])
            at = np.zeros(len(key), np.int64)
            if len(totals):
                rank, _, starts = _distinct(key[there])
                at[np.flatnonzero(there)[rank]] = np.repeat(totals, np.diff(starts, append=len(rank)))
            counts.append(at)
        n_tokens, n_known, n_failed, base, score = block.walk(counts, total, distinct)
        columns = [x["row"], x["part"], x["parts"], x["doc_id"], x["held_out"], n_tokens, n_known, n_failed, base, score]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCORED.split(", ")])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_failed, train_tokens, base_score, score of every whole text.

    Tokens are words (A-Z lower-cased), then one end, which is also what precedes the first word.  The model counts all
    n-grams of up to ORDER tokens of the rows that are not held out; score is the log10 probability that it gives the
    text, unknown words being one token.  base_score adds a half to unigram counts instead, which is also the root of
    the automaton.  n_failed counts the failure arcs taken.

    Null and empty texts are one end.  A null doc_id is held in.  Rows that repeat doc_id and text have equal scores.
    Texts of more than BLOCK tokens are walked in pieces that know the history before them.  With nothing to learn
    from, every token has the unknown token's probability.  Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    out_of_sample = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out_of_sample.alias("held_out"), "text")
    blocks = scratch.save(rows.mapInArrow(_to_blocks, _BLOCKS), "blocks")
    sizes = blocks.select(F.explode("size").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-8 * sizes // SHARD))
    asking = blocks.select("block", "size", "skip", "held_out", "words", "codes")
    for order in range(ORDER):  # one at a time, so that no more than one order's questions are on disk
        asked = asking.mapInArrow(_ask(shards, order), "shard long, block long, keys binary, n binary")
        answers = scratch.append(asked.groupBy("shard").applyInArrow(_sum_shard, "shard long, block long, totals binary, total long, distinct long"), "answers")
    total, distinct = (int(x or 0) for x in answers.filter(f"block is null and shard % {ORDER} = 0").agg(F.sum("total"), F.sum("distinct")).first())
    answers = answers.filter("block is not null").select("block", "shard", "totals")
    scored = scratch.save(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_walk(total, distinct), _SCORED), "scored")
    scratch.drop("blocks", "answers")
    whole = scored.filter("parts = 1").select("doc_id", "held_out", "n_tokens", "n_known", "n_failed", "base", "score")
    pieces = scored.filter("parts > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.array_sort(F.collect_list(F.struct("part", "n_tokens", "n_known", "n_failed", "base", "score"))).alias("p"))
    # in the order of the pieces, so that sums don't depend on how tasks end
    added = lambda c, zero: F.aggregate("p", F.lit(zero).cast("double" if zero == 0.0 and isinstance(zero, float) else "long"), lambda a, x: a + x[c]).alias(c)
    pieces = pieces.select("doc_id", "held_out", added("n_tokens", 0), added("n_known", 0), added("n_failed", 0), added("base", 0.0), added("score", 0.0))
    return whole.union(pieces).select("doc_id", "held_out", "n_tokens", "n_known", "n_failed", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
