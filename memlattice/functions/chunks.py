"""Chunking of texts by sentences, paragraphs, headings or topics, as Arrow-batched functions that return arrays of chunks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_SENTENCE, _PARAGRAPH, _HEADER = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n\s*\n"), re.compile(r"^(#{1,6}\s+.*)$", re.MULTILINE)
_CODE = re.compile(r"```[\s\S]*?```|`[^`]+`")


def by_characters(text: str, size: int, lap: int) -> list[str]:
    """Stretches of `size` characters, each starting `size - lap` after the one before."""
    if lap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    return [text[at : at + size] for at in range(0, len(text), size - lap)]


def _packed(units: list[str], size: int, glue: str, finer: Callable[[str], list[str]], tail: Callable[[list[str]], list[str]]) -> list[str]:
    """Units joined into chunks of up to `size`; a unit over it is cut by `finer`, and a new chunk starts with the `tail` of the last."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for unit in units:
        if len(unit) > size:
            out += [glue.join(held)] * bool(held) + finer(unit)
            held, used = [], 0
        elif used + len(unit) + len(glue) > size:
            out += [glue.join(held)] * bool(held)
            held = [*tail(held), unit]
            used = len(glue.join(held))
        else:
            held.append(unit)
            used += len(unit) + len(glue)
    return out + [glue.join(held)] * bool(held)


def by_sentences(text: str, size: int, lap: int) -> list[str]:
    """Whole sentences up to `size`; the next chunk repeats the last ones that fit into `lap`."""

    def tail(held: list[str]) -> list[str]:
        room, kept = lap, 0
        for sentence in reversed(held):
            room -= len(sentence) + 1
            if room < 0:
                break
            kept += 1
        return held[len(held) - kept :]

    return _packed(_SENTENCE.split(text), size, " ", lambda x: by_characters(x, size, lap), tail)


def by_paragraphs(text: str, size: int, lap: int) -> list[str]:
    """Whole paragraphs up to `size`; longer ones by sentences."""
    parts = [p.strip() for p in _PARAGRAPH.split(text) if p.strip()]
    return _packed(parts, size, "\n\n", lambda x: by_sentences(x, size, lap), lambda _: [])


def recursive(text: str, size: int, lap: int) -> list[str]:
    """By paragraphs, by sentences where there is one paragraph only that is too long, by characters below that."""
    parts = [p for p in _PARAGRAPH.split(text) if p.strip()]
    return by_sentences(text, size, lap) if len(parts) == 1 and len(parts[0].strip()) > size else by_paragraphs(text, size, lap)


def by_markdown(text: str, size: int, lap: int) -> list[str]:
    """Sections at headings, code kept whole; a section that overflows starts anew under its heading.  By paragraphs where there is one chunk."""
    code = _CODE.findall(text)
    places = iter(range(len(code)))
    sections = [s for s in _HEADER.split(_CODE.sub(lambda _: f"\x00{next(places)}\x00", text)) if s.strip()]
    out: list[str] = []
    held = header = ""
    for section in sections:
        is_header, over = bool(_HEADER.match(section)), len(held) + len(section) > size
        if over and held:
            out.append(held)
        if is_header:
            held, header = section if over and held else held + section, section
        elif over:
            held = f"{header}\n{section}" if header else section
        else:
            held += f"\n{section}"
    whole = [re.sub(r"\x00(\d+)\x00", lambda m: code[int(m[1])], x).strip() for x in [*out, held]]
    whole = [x for x in whole if x]
    return by_paragraphs(text, size, lap) if len(whole) <= 1 and text.strip() else whole


def _bag_cosine(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    norm = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
    return sum(n * y[w] for w, n in x.items()) / norm if norm else 0.0


def by_topic(text: str, size: int, lap: int, threshold: float = 0.85, similarity: Callable[[str, str], float] = _bag_cosine) -> list[str]:
    """Runs of sentences that are each similar enough to the one before, up to `size`; longer sentences by characters."""
    out: list[str] = []
    held: list[str] = []
    for sentence in (s for s in _SENTENCE.split(text) if s.strip()):
        if held and (similarity(held[-1], sentence) < threshold or len(" ".join([*held, sentence])) > size):
            out.append(" ".join(held))
            held = []
        held.append(sentence)
    out += [" ".join(held)] * bool(held)
    return [x for chunk in out for x in (by_characters(chunk, size, lap) if len(chunk) > size else [chunk])]


STRATEGIES: dict[str, Callable[[str, int, int], list[str]]] = {"character": by_characters, "sentence": by_sentences, "paragraph": by_paragraphs, "recursive": recursive, "markdown": by_markdown, "semantic": by_topic}


def chunks(text: Column, strategy: str, size: int, lap: int = 0) -> Column:
    """array<string>: the chunks of a text by a named strategy; null and empty texts have none."""
    if lap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    cut = STRATEGIES[strategy]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: cut(x, size, lap) if x else [])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


#: Texts that a task cuts at once.
SLICE = 128


def chunked(rows: DataFrame, text: str, strategy: str, size: int, lap: int = 0) -> DataFrame:
    """rows with `chunks` in place of the text, see chunks: a few texts of an Arrow batch are cut and sent at a time, so that
    a task holds neither a batch's strings nor its chunks at once."""
    if lap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    cut = STRATEGIES[strategy]
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pa.array([cut(x, size, lap) if x else [] for x in part.column(text).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], found], names=[*kept, "chunks"])

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept]]).add("chunks", ArrayType(StringType())))
