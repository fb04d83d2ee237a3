"""Secret scans: Boolean trigram queries from each rule, answered by intersecting the postings of every block of documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from re import _constants as _ops, _parser
except ImportError:  # older Pythons
    import sre_constants as _ops
    import sre_parse as _parser

#: A Boolean query: any of these sets, each of trigrams that must all occur.  None: the rule has no mandatory trigrams.
Query = frozenset[frozenset[str]] | None
#: More alternatives than this are not enumerated.
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind, pattern (ASCII semantics) and the least size of the group that counts; smaller matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The contract's base kinds, in its order.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Published formats of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z]{3,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[^\s/]+"),
)


def _strings(items: list) -> list[set[str] | None]:
    """For each part of a parsed pattern, the lower-cased strings that it can be, or None where they are unbounded or many."""
    out: list[set[str] | None] = []
    for op, arg in items:
        if op is _ops.LITERAL:
            out.append({chr(arg).lower()})
        elif op is _ops.IN and all(k in (_ops.LITERAL, _ops.RANGE) for k, _ in arg):
            chars = {chr(c).lower() for k, a in arg for c in ([a] if k is _ops.LITERAL else range(a[0], min(a[1], a[0] + 8) + 1))}
            wide = any(k is _ops.RANGE and a[1] - a[0] > 8 for k, a in arg)
            out.append(None if wide or len(chars) > 8 else chars)
        elif op is _ops.SUBPATTERN:
            out += [_joined(list(arg[3]))] if _joined(list(arg[3])) is not None else _strings(list(arg[3]))
        elif op is _ops.BRANCH:
            choices = [_joined(list(x)) for x in arg[1]]
            out.append(None if any(x is None for x in choices) else set().union(*choices))
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and arg[1] <= 3:
            one = _joined(list(arg[2]))
            out.append(None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)})
        else:
            out.append(None)
        if out[-1] is not None and len(out[-1]) > _MOST_STRINGS:
            out[-1] = None
    return out


def _joined(items: list) -> set[str] | None:
    whole: set[str] = {""}
    for part in _strings(items):
        if part is None or len(whole) * len(part) > _MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def trigram_query(pattern: str) -> Query:
    """Trigrams (of lower-cased text) without which the pattern can't match: the stretch that gives the longest shortest string."""
    best: set[str] | None = None
    stretch: set[str] = {""}
    parts = [*_strings(list(_parser.parse(pattern))), None]
    for part in parts:
        if part is not None and len(stretch) * len(part) <= _MOST_STRINGS:
            stretch = {a + b for a in stretch for b in part}
            continue
        if best is None or min(map(len, stretch)) > min(map(len, best)):
            best = stretch
        stretch = set(part) if part is not None else {""}
    if best is None or min(map(len, best)) < 3:
        return None
    return frozenset(frozenset(x[k : k + 3] for k in range(len(x) - 2)) for x in best)


def _codes(trigrams: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(t.encode("ascii"), "big") for t in trigrams], np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def build_index(texts: list[str], wanted: list[str]) -> dict[str, np.ndarray]:
    """Postings of the wanted trigrams: sorted rows of the block whose lower-cased text holds each.

    One pass over the block's bytes: every three make a code, wanted codes are looked up in a table of all, and their
    (trigram, row) pairs, sorted and grouped, are the postings.  Texts are parted by a byte that no trigram has.
    """
    raw = [x.encode() for x in texts]
    a = _LOWER[np.frombuffer(b"\0".join(raw), np.uint8)].astype(np.int32)
    codes = _codes(wanted)
    table = np.zeros(1 << 24, np.int16)
    table[codes] = np.arange(1, len(wanted) + 1)
    found = table[(a[:-2] << 16) | (a[1:-1] << 8) | a[2:]] if len(a) > 2 else np.zeros(0, np.int16)
    at = np.flatnonzero(found)
    starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
    pairs = np.unique(found[at].astype(np.int64) * (len(texts) + 1) + np.searchsorted(starts, at, "right") - 1)
    kind, row = pairs // (len(texts) + 1), pairs % (len(texts) + 1)
    bounds = np.searchsorted(kind, np.arange(1, len(wanted) + 2))
    return {t: row[bounds[k] : bounds[k + 1]] for k, t in enumerate(wanted)}


def candidates(query: Query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that may match: the union over alternatives of the intersection of postings, from the rarest trigram on."""
    if query is None:
        return np.arange(n)
    found = []
    for need in query:
        lists = sorted((index[t] for t in need), key=len)
        rows = lists[0]
        for other in lists[1:]:
            if not len(rows):
                break
            rows = np.intersect1d(rows, other, assume_unique=True)
        found.append(rows)
    return np.unique(np.concatenate(found))


#: Characters of the texts that are indexed together.
_BLOCK = 1 << 22
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(rules: tuple[Rule, ...]) -> Callable:
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries if q for need in q for t in need})
    # maximal runs of one class: only those long enough are found, the same ones
    patterns = [re.compile(r.pattern.replace("[0-9a-f]+", f"[0-9a-f]{{{r.least},}}") if r.kind == "hex" else r.pattern, re.ASCII) for r in rules]

    def scan(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        at = 0
        while at < len(texts):
            end, room = at, _BLOCK
            while end < len(texts) and (end == at or room > 0):
                room -= len(texts[end])
                end += 1
            yield from scan_block(texts[at:end])
            at = end

    def scan_block(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = build_index(texts, wanted)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
            for row in candidates(query, index, len(texts)).tolist():
                for m in pattern.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[row].append((m.start(), k, m.end()))
        return spans

    return scan


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans array of struct(kind, start, end)) of every whole text, by start, then by the rules' order.

    Offsets are code points, end exclusive.  Matches of a rule are leftmost and don't overlap; those whose counting
    group is too short are dropped.  Spans of different rules may overlap.  Null and empty texts have no spans, and
    no rows give none; repeated rows are rows of their own, a null doc_id stays null, other columns are ignored.  A very
    long text is a block by itself; every rule's pattern takes time in proportion to it.

    The inverted index is dealt by documents: each task indexes the blocks that it reads, intersects postings there and
    verifies the candidates, so that nothing is shuffled.
    """
    scan = _scan(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan([x or "" for x in batch.column("text").to_pylist()])
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(row)] for row in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {_SPANS}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
