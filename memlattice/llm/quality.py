"""Quality by a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, hash_batch
from .labelled import held_out, labelled_sample

#: At most so many labelled documents are learned from, so many bytes of their texts in all, and of one text.
LABELLED, LEARNED_BYTES, LONGEST = 12_000, 1 << 28, 1 << 20
WORD_BUCKETS, RANK = 1 << 15, 8
#: Passes over the sample, the largest minibatch, and the least number of steps.
EPOCHS, BATCH, STEPS = 6, 256, 300
#: Classes of bytes: 1 upper case, 2 lower case, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 bar, 8 other ASCII, 9 above ASCII.
_CLASS = np.full(256, 8, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[[44, 46, 59, 58, 63, 33]], _CLASS[124] = 4, 5, 6, 7
#: Bin edges: of shares, and of logarithms of counts.
_SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
_LOGS = np.arange(0.5, 15.5)
_BINS = 16
_STATS = 14
FEATURES = WORD_BUCKETS + _BINS * _STATS


def _stat_features(raw: bytes, words: np.ndarray) -> np.ndarray:
    """One feature for each statistic: its bin."""
    a = np.frombuffer(raw, np.uint8)
    share = np.bincount(_CLASS[a], minlength=10)[1:] / max(1, len(a))
    n, distinct = len(words), len(np.unique(words))
    lines = int(share[4] * len(a) + 0.5) + 1
    shares = np.searchsorted(_SHARES, [*share, distinct / max(1, n), 1 - len(a) / max(1, len(a) + 8 * n)], "right")
    logs = np.searchsorted(_LOGS, np.log1p([n, lines, n / lines]), "right")
    return WORD_BUCKETS + _BINS * np.arange(_STATS) + np.concatenate((shares, logs))


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, value) of runs of texts: words weigh the root of their share, statistics one each."""
    for at, end, words, bounds in hash_batch(texts):
        n = np.diff(bounds)
        row = np.repeat(np.arange(end - at), n)
        keys, counts = np.unique(row * WORD_BUCKETS + (words >> np.uint64(49)).astype(np.int64), return_counts=True)
        rows = keys // WORD_BUCKETS
        stats = np.array([_stat_features(texts[at + k] or b"", words[bounds[k] : bounds[k + 1]]) for k in range(end - at)])
        yield (
            np.concatenate((rows, np.repeat(np.arange(end - at), _STATS))) + at,
            np.concatenate((keys % WORD_BUCKETS, stats.ravel())),
            np.concatenate((np.sqrt(counts / n[rows]), np.ones(stats.size))).astype(np.float32),
        )


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and each row's sum of factors; pairwise terms by (sum)^2 - sum of squares, linear in the features."""
        vx = self.factors[feature] * value[:, None]
        total = np.column_stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])])
        squares = np.bincount(row, (vx * vx).sum(axis=1), n)
        return self.bias + np.bincount(row, self.linear[feature] * value, n) + 0.5 * ((total**2).sum(axis=1) - squares), total

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for row, feature, value in features(texts):
            first, last = int(row.min()), int(row.max())
            raw, _ = self.raw(row - first, feature, value, last - first + 1)
            out[first : last + 1] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return out


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by minibatches with AdaGrad steps.  row is sorted."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK)))
    if not len(label):
        return model
    mean = np.clip(label.mean(), 0.01, 0.99)
    model.bias = float(np.log(mean / (1 - mean)))
    bounds = np.searchsorted(row, np.arange(len(label) + 1))
    linear_sum, factor_sum = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2)
    batch = min(BATCH, max(16, len(label) // 20))
    epochs = max(EPOCHS, -(-STEPS * batch // len(label)))
    for epoch in range(epochs):
        step = 0.1 / (1 + 1.8 * epoch / epochs)
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            take = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            r = np.repeat(np.arange(len(docs)), bounds[docs + 1] - bounds[docs])
            f, x = feature[take], value[take].astype(float)
            raw, total = model.raw(r, f, x, len(docs))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[docs]) / len(docs)
            e = error[r] * x
            used, place = np.unique(f, return_inverse=True)
            g = np.bincount(place, e) + 1e-5 * model.linear[used]
            by_factor = e[:, None] * (total[r] - model.factors[f] * x[:, None])
            gv = np.column_stack([np.bincount(place, by_factor[:, k]) for k in range(RANK)]) + 1e-5 * model.factors[used]
            linear_sum[used] += g * g
            factor_sum[used] += gv * gv
            model.linear[used] -= step * g / np.sqrt(linear_sum[used])
            model.factors[used] -= step * gv / np.sqrt(factor_sum[used])
            model.bias -= step * float(error.sum())
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binaries(batch.column("text"))
        feature, value = [], []
        for row, f, x in features(texts):
            order = np.argsort(row, kind="stable")
            cuts = np.cumsum(np.bincount(row - row.min()))[:-1]
            feature += np.split(f[order].astype(np.int32), cuts)
            value += np.split(x[order], cuts)
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label").cast(pa.int32()), pa.array(feature, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["h", "label", "feature", "value"])


def learn_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> FactorisationMachine:
    """A machine fitted on at most `limit` labelled documents outside the held-out fold, of LEARNED_BYTES at most in all.

    Documents come in the order of a hash of their text, so that reruns agree.  A text of more than LONGEST bytes, or of
    more than the documents before it have left, is not learned from; those behind it are.
    """
    sample = labelled_sample(docs, labels, "quality", limit).withColumn("h", F.xxhash64("text", "label"))
    sizes = sample.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).toPandas().sort_values(["h", "n"])
    room, left_out = LEARNED_BYTES, set()
    for h, n in zip(sizes["h"].tolist(), sizes["n"].tolist(), strict=True):
        if n > min(LONGEST, room):
            left_out.add(h)
        else:
            room -= n
    if left_out:
        names = docs.sparkSession.createDataFrame([(h,) for h in sorted(left_out)], "h long")
        sample = sample.join(F.broadcast(names), "h", "left_anti").select("text", "label", "h")
    rows = sample.mapInArrow(_extract, "h long, label int, feature array<int>, value array<float>").toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    feature, value = (rows.column(k).combine_chunks() for k in ("feature", "value"))
    sizes = np.array([len(x) for x in feature], np.int64) if len(rows) else np.zeros(0, np.int64)
    flat = lambda x: x.flatten().to_numpy() if len(rows) else np.zeros(0)
    return fit(np.repeat(np.arange(len(sizes)), sizes), flat(feature).astype(np.int64), flat(value), rows.column("label").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every whole text.

    Null and empty texts score by their statistics alone; a very long text is one text.  Repeated rows score alike, a
    null doc_id stays null, no rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(binaries(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
