"""License scans: word k-grams of texts joined to those of license templates, votes by diagonal, verified spans."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, FOLDED, Scratch, broadcast_if_small, buffers, hash_spans, mix, word_spans

#: Words of a gram: the shortest phrase has three.
GRAM = 3
#: Diagonals that differ by at most so many words are one, and so many words more are read at either end.
GAP = 16
#: Share of a template's grams that must vote for a place, and of its words that must stand there in order.
VOTES, COVERED = 0.35, 0.8

# Wording that names or grants a license.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
PHRASES = {
    "the mit license mit": "mit",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "attribution noncommercial 4 0 international": "cc-by-nc",
    "attribution sharealike 4 0 international": "cc-by-sa",
    "attribution 4 0 international": "cc-by",
    "cc by sa": "cc-by-sa",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "creative commons zero": "cc0",
}
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
}


def words_of(text: str) -> list[bytes]:
    """A text's words: letters, digits and all above ASCII, A-Z lower-cased."""
    a, bounds = buffers(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(a, bounds, ALNUM_BYTES)
    return [a[s:e].tobytes().lower() for s, e in zip(starts, ends, strict=True)]


class Templates:
    """Numbered templates: (words, label, kind), kind being base, phrase or text."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS):
        rows = [*((p, x, "base") for p, x in base.items()), *((p, x, "phrase") for p, x in phrases.items()), *((t, x, "text") for x, t in texts.items())]
        self.words = [words_of(p) for p, _, _ in rows]
        self.labels, self.kinds = [x for _, x, _ in rows], [k for _, _, k in rows]
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template has {GRAM} words or more")

    def table(self, spark: SparkSession) -> DataFrame:
        """(h, template, at): every template's grams; as many rows as the templates have words, whatever the corpus."""
        rows = []
        for k, words in enumerate(self.words):
            hashes, _ = _gram_hashes(*buffers(pa.array([b" ".join(words).decode()])))
            rows += [(int(h), k, at) for at, h in enumerate(hashes.view(np.int64))]
        return spark.createDataFrame(rows, "h long, template int, at int")


def _gram_hashes(a: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes at every word of a buffer's rows (those that run over a row's end mean nothing), and first words."""
    starts, ends, first = word_spans(a, bounds, ALNUM_BYTES)
    words = hash_spans(a, starts, ends, FOLDED)
    n = max(0, len(words) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n]
    return mix(out), first


#: Grams in one Arrow batch.
_ROWS = 1 << 17


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each gram of each text, at its first word, and one at -1 with the number of words in h."""
    for batch in batches:
        a, bounds = buffers(batch.column("text"))
        hashes, first = _gram_hashes(a, bounds)
        words = np.diff(first)
        ids, keys = batch.column("doc_id").cast(pa.int64()), batch.column("text_hash")
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.full(len(words), -1, np.int32)), pa.array(words)], names=["doc_id", "text_hash", "pos", "h"])
        grams = np.maximum(words - GRAM + 1, 0)
        done = np.concatenate(([0], np.cumsum(grams)))
        for low in range(0, int(done[-1]), _ROWS):
            k = np.arange(low, min(low + _ROWS, int(done[-1])))
            row = np.searchsorted(done, k, "right") - 1
            pos = k - done[row]
            some = pa.array(row)
            yield pa.RecordBatch.from_arrays([ids.take(some), keys.take(some), pa.array(pos.astype(np.int32)), pa.array(hashes[first[row] + pos].view(np.int64))], names=["doc_id", "text_hash", "pos", "h"])


_ROW = "doc_id long, text_hash long, "
_FOUND = _ROW + "n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:int,end:int,score:double>>"


def _exact(words: list[bytes], at: int, want: list[bytes]) -> bool:
    return at >= 0 and words[at : at + len(want)] == want


def _verify(words: list[bytes], places: list[dict], templates: Templates) -> tuple:
    """What of a text's proposed places holds: phrases word by word, texts by the share of their words found in order."""
    base, labels, spans = [], {}, []
    for template, start in sorted({(p["template"], p["start"]) for p in places}):
        want, label, kind = templates.words[template], templates.labels[template], templates.kinds[template]
        if _exact(words, start, want):
            low, high, share = start, start + len(want), 1.0
        elif kind == "text":
            low = max(0, start - GAP)
            blocks = SequenceMatcher(None, words[low : start + len(want) + GAP], want, autojunk=False).get_matching_blocks()
            share = sum(b.size for b in blocks) / len(want)
            if share < COVERED:
                continue
            low, high = low + blocks[0].a, low + blocks[-2].a + blocks[-2].size
        else:
            continue
        base += [(start, label)] if kind == "base" else []
        labels[label] = max(share, labels.get(label, 0.0))
        spans.append({"label": label, "start": low, "end": high, "score": share})
    at = [s for s, _ in base]
    return len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), sorted(labels), max(labels.values(), default=0.0), sorted(spans, key=lambda x: (x["start"], x["end"], x["label"]))


def scan_licenses(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """License labels of every text: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Every rolling k-gram of words is joined to the templates' positions; a gram at word p that is a template's at q votes
    for the diagonal p - q, where that template would start.  A phrase's place needs all its votes.  A longer text's
    diagonals are merged with those near them, and the best of each neighbourhood is a place if it has VOTES of them.
    Places are then verified in the text: phrases word by word, longer texts by COVERED of their words in order.
    score is the largest such share, 1 for phrases, 0 without labels.

    The votes of a place are distinct template positions, so repeated rows don't add any; they share their result.  No
    group is larger than one text.  Null and empty texts have no words and no labels; a null doc_id stays null; a very
    long text is scanned whole, in blocks; no documents give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = templates or Templates()
    scratch = Scratch(spark, "licenses")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    grams = keyed.mapInArrow(_grams, _ROW + "pos int, h long")
    joined = grams.join(F.broadcast(templates.table(spark)), "h", "left")
    hits = scratch.save(joined.filter("pos = -1 or template is not null").select("doc_id", "text_hash", "pos", F.when(F.col("pos") == -1, F.col("h")).alias("n_words"), F.when(F.col("pos") >= 0, F.col("template")).alias("template"), "at"), "hits")
    key = ["doc_id", "text_hash"]
    votes = hits.filter("template is not null").groupBy(*key, "template", (F.col("pos") - F.col("at")).alias("start")).agg(F.size(F.collect_set("at")).alias("votes"))
    sizes = F.create_map(*[F.lit(x) for k, w in enumerate(templates.words) for x in (k, len(w) - GRAM + 1)])
    is_text = F.col("template").isin([k for k, kind in enumerate(templates.kinds) if kind == "text"])
    phrases = votes.filter(~is_text & (F.col("votes") == sizes[F.col("template")])).select(*key, "template", "start")
    near = Window.partitionBy(*key, "template").orderBy("start").rangeBetween(-GAP, GAP)
    bands = votes.filter(is_text).withColumn("band", F.sum("votes").over(near)).filter(F.col("band") >= F.lit(VOTES) * sizes[F.col("template")])
    rank = F.struct("band", "votes", -F.col("start"))
    texts = bands.withColumn("best", F.max(rank).over(near)).filter(F.col("best") == rank).select(*key, "template", "start")
    places = phrases.union(texts).groupBy(*key).agg(F.collect_list(F.struct("template", "start")).alias("places"))
    places = scratch.save(places, "places").select(F.col("doc_id").alias("p_doc"), F.col("text_hash").alias("p_hash"), "places")
    # the places of one text are as many as its words at most: a broadcast is bounded by counting them all
    few = places.select(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= 1_000_000
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("text_hash") == F.col("p_hash"))
    proposed = keyed.join(broadcast_if_small(places) if few else places, same).select(*key, "text", "places")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        for batch in batches:
            rows = []
            for doc, text_hash, text, proposals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "places")), strict=True):
                rows.append((doc, text_hash, *_verify(words_of(text), proposals, templates)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = scratch.save(proposed.mapInArrow(verify, _FOUND).dropDuplicates(key), "found")
    found = broadcast_if_small(found) if few else found
    base = hits.filter("pos = -1").select(*key, "n_words")
    f = found.select(F.col("doc_id").alias("p_doc"), F.col("text_hash").alias("p_hash"), *found.columns[2:])
    none = F.array().cast("array<string>")
    return base.join(f, same, "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ",")).drop("spans")
