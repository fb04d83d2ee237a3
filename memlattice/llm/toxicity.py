"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, a score by density."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binaries, hash_words, mix, shingle_hashes
from .labelled import held_out, labelled_sample

#: At most so many labelled documents are learned from.
LABELLED = 20_000
#: Word beginnings of these lengths are entries beside whole words.
PREFIXES = range(4, 9)
#: Words added to a text's length, so that one hit in a few words isn't taken for a high density.
LENGTH_FLOOR = 30
THRESHOLD = 0.7

# Cyrillic and Greek letters that look like Latin ones, and what stands for letters inside words.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнɡαβγεικνορτυχωɑ", "aeopcyxijsdhlkmtbhgabyeiknoptuxwa", strict=True))
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
_SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}


def _fold_table() -> dict[int, str]:
    """Lower case, no marks, compatibility forms, look-alikes, digits for letters; i, l and 1 are one letter."""
    table: dict[int, str] = {}
    for k in [*range(0x20, 0x2000), *range(0x2100, 0x2200), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x)).lower()
        plain = "".join(_LEET.get(y, y) for y in (_LOOKALIKES.get(x, x) for x in plain))
        if plain != chr(k):
            table[k] = plain
    return table | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")


_FOLD = _fold_table()
_INSIDE = re.compile(r"(?<=\w)[@$!|](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    return _WORD.findall(_INSIDE.sub(lambda m: _SYMBOLS[m[0]], (text or "").translate(_FOLD)))


@dataclass
class Lexicon:
    """entries: " word " or " beginning" to weight; exceptions: phrases whose hits don't count; the score's slopes by
    density and by the sum of weights, and its shift."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slopes: tuple[float, float] = (0.0, 0.0)
    shift: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            out.add_word(entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        if len(out):
            out.make_automaton()
        return out


def find_hits(words: list[str], automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Weight by place (in the folded words joined by spaces): the heaviest entry that starts there, if no exception covers it."""
    if not len(automaton):
        return {}
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight, _) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    if not excused:
        return hits
    # the union of the excused stretches, so that each hit is looked up once
    starts, ends = [], []
    for a, b in sorted(excused):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    inside = lambda k: (at := bisect_right(starts, k) - 1) >= 0 and k < ends[at]
    return {k: w for k, w in hits.items() if not inside(k)}


def evidence(words: list[str], hits: dict[int, float]) -> tuple[float, float]:
    """Logarithms of the density of weighted hits, normalised by length, and of their sum."""
    total = sum(hits.values())
    return math.log1p(50 * total / (len(words) + LENGTH_FLOOR)), math.log1p(total)


def _score(words: list[str], hits: dict[int, float], lexicon: Lexicon) -> float:
    x = sum(a * b for a, b in zip(lexicon.slopes, evidence(words, hits), strict=True)) + lexicon.shift
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each word or beginning, summed over the task."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(fold(text))
            found = {f" {w} " for w in words}
            found.update(f" {w[:n]}" for n in PREFIXES for w in words if len(w) >= n)
            counts[label > 0].update(found)
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in counts)], names=["term", "clean", "toxic"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two minwise hashes of each text's shingles, by which near copies mostly agree."""
    for batch in batches:
        least = []
        for text in binaries(batch.column("text")):
            s = shingle_hashes(hash_words(text or b""), 4)
            least.append((int(s[0]), int(mix(s).min())) if len(s) else (0, 0))
        s1, s2 = (pa.array(np.array([x[k] for x in least], np.uint64).view(np.int64)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, s1, s2], names=[*batch.schema.names, "s1", "s2"])


def _evidence(toxic: int, clean: int, share: float) -> float:
    """Nats by which a term's share of toxic documents exceeds the common one."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0.0)


def _entries(rows: list, toxic_docs: int, clean_docs: int, terms: int) -> dict[str, float]:
    share = toxic_docs / max(1, toxic_docs + clean_docs)
    found: dict[str, tuple[float, float, float]] = {}
    for term, clean, toxic in rows:
        strong = _evidence(toxic, clean, share)
        if strong >= math.log(2 * max(1, terms)):
            weight = math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log((clean + 0.5) / (clean_docs + 1))
            found[term] = (strong, weight, toxic / (toxic + clean))
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda x: (len(x), x)):  # a beginning makes what it covers superfluous, unless that is purer
        shorter = [term[:n] for n in range(5, len(term)) if term[:n] in kept]
        if not any(found[x][2] >= found[term][2] - 1e-9 for x in shorter):
            kept[term] = min(8.0, found[term][1])
    return kept


def _observe(lexicon: Lexicon) -> Callable:
    """For each document: label, evidence and the phrases of a hit with the word before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found, phrases = [], []
            for text in batch.column("text").to_pylist():
                words = fold(text)
                hits = find_hits(words, automaton)
                near: set[str] = set()
                if hits:
                    places = np.cumsum([0, *(len(w) + 1 for w in words)])
                    for at in np.searchsorted(places, sorted(hits)).tolist():
                        near.update(" ".join(words[a:b]) for a, b in ((at - 1, at + 1), (at, at + 2)) if a >= 0 and b <= len(words))
                found.append(evidence(words, hits))
                phrases.append(sorted(near))
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(found, pa.list_(pa.float64())), pa.array(phrases, pa.list_(pa.string()))], names=["label", "evidence", "phrases"])

    return run


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes and shift of a logistic score, with a little regularisation, by Newton's steps; no slope falls below 0."""
    if not len(y):
        return (0.0, 0.0), 0.0
    design, ridge = np.column_stack([x, np.ones(len(x))]), np.array([0.1, 0.1, 0.01])
    used = np.ones(3, bool)
    for _ in range(3):
        beta, d, r = np.zeros(int(used.sum())), design[:, used], ridge[used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(d @ beta, -50, 50)))
            step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.diag(r), d.T @ (p - y) + r * beta)
            beta -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        whole = np.zeros(3)
        whole[used] = beta
        if (whole[:2] >= 0).all():
            break
        used[:2] &= whole[:2] >= 0
    return (float(whole[0]), float(whole[1])), float(whole[2])


def learn_lexicon(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Lexicon:
    """A lexicon from at most `limit` labelled documents outside the held-out fold.

    Entries are the words and word beginnings whose documents are toxic more often than chance explains over all terms.
    Near copies among the documents count once.
    Phrases of an entry that three clean documents or more hold, and no toxic one, become exceptions.
    """
    sample = labelled_sample(docs, labels, "toxic", limit)
    # copies of a toxic document are no further evidence against its words
    sample = sample.mapInArrow(_signed, "text string, label int, s1 long, s2 long")
    for s in ("s1", "s2"):  # of each the text with the least hash, so that reruns agree
        sample = sample.groupBy("label", s).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", *[x for x in ("s2",) if x != s])).alias("m")).select("label", "m.*")
    sample = Scratch(docs.sparkSession, "toxicity").save(sample.select("text", "label"), "sample")
    terms = sample.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean, n_terms = totals.get(1, 0), totals.get(0, 0), 100 * max(1000, sum(totals.values()))
    share, p = n_toxic / max(1, n_toxic + n_clean), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # the terms whose evidence may suffice; as many as the sample's toxic documents support
    strong = F.col("toxic") * F.log(p / F.lit(share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    enough = terms.filter("toxic > 2").filter((p > F.lit(share)) & (strong >= F.lit(math.log(2 * n_terms) - 1e-6))) if 0 < share < 1 else terms.limit(0)
    lexicon = Lexicon(_entries([tuple(r) for r in enough.select("term", "clean", "toxic").collect()], n_toxic, n_clean, n_terms))
    observed = lambda: sample.mapInArrow(_observe(lexicon), "label int, evidence array<double>, phrases array<string>")
    phrase = observed().select((F.col("label") > 0).alias("toxic"), F.explode("phrases").alias("phrase")).groupBy("phrase")
    harmless = phrase.agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic")).filter("clean >= 3 and toxic = 0")
    lexicon.exceptions = [r["phrase"] for r in harmless.select("phrase").orderBy("phrase").collect()]
    # two numbers for each document of the sample
    seen = observed().select("label", "evidence").toPandas()
    lexicon.slopes, lexicon.shift = _calibrate(np.array(seen["evidence"].tolist()).reshape(-1, 2), (seen["label"] > 0).to_numpy(float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits, n_words of every whole text.

    Null and empty texts score as texts without hits; a very long text is one text.  Repeated rows score alike, a null
    doc_id stays null, no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = fold(text)
                hits = find_hits(words, automaton)
                out.append((_score(words, hits, lexicon), len(hits), len(words)))
            score, n_hits, n_words = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array(n_hits, pa.int64()), pa.array(n_words, pa.int64())], names=["doc_id", "score", "n_hits", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_hits long, n_words long")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the texts that score the threshold or more; all columns as they were, in one pass over the rows."""
    lexicon = learn_lexicon(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                words = fold(text)
                keep.append(_score(words, find_hits(words, automaton), lexicon) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    scored = score_toxicity(docs, learn_lexicon(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_words")
