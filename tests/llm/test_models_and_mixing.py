"""Learned operators on small corpora, mixing, neighbours, preferences and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import language_model, neighbours, preferences, quality
from memlattice.llm.labelled import labelled_sample
from memlattice.llm.language_model import score_texts
from memlattice.llm.mixing import mix_sources
from memlattice.llm.neighbours import nearest
from memlattice.llm.quality import FEATURES, FactorisationMachine, features, learn_quality, score_quality
from memlattice.llm.toxicity import Lexicon, find_hits, fold, learn_lexicon, score_toxicity

WORDS = [f"word{k}" for k in range(300)]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(WORDS, k=rng.randint(20, 60))
        toxic = k % 5 == 0
        junk = k % 7 == 0
        if toxic:
            for at in rng.sample(range(len(w)), 3):
                w[at] = rng.choice(["loser", "idiotic", "L0SER", "idi0t"])
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_folding_and_exceptions():
    assert fold("L0SER lоser ＬＯＳＥＲ lo​ser lös€r") == ["ioser"] * 4 + ["ios", "r"]
    lexicon = Lexicon({" ioser ": 2.0, " idiot": 1.0}, ["no ioser"])
    words = fold("no loser here, idiots and a loser")
    assert sorted(find_hits(words, lexicon.automaton()).values()) == [1.0, 2.0]
    assert find_hits(["a"], Lexicon({}).automaton()) == {}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    lexicon = learn_lexicon(d, y)
    rows = {r.doc_id: r.score for r in score_toxicity(d, lexicon).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 50 and all((rows[k] >= 0.7) == (k % 5 == 0) for k in held)


def test_learned_scores_of_awkward_rows(spark):
    docs, labels = corpus(60)
    extra = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1001, "", "en", "s", 0), (None, "x", "en", "s", 1), (1002, "loser " * 50_000, "en", "s", 1)]
    d = spark.createDataFrame([*docs, *extra], DOCS)
    y = spark.createDataFrame([*labels, (1, 0, 1), (None, 1, 1), (2, None, None), (1001, 1, 0)], LABELS)
    for scored in (score_toxicity(d, learn_lexicon(d, y)), score_quality(d, learn_quality(d, y))):
        rows = scored.collect()
        assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    assert labelled_sample(d, y, "toxic", 10).count() <= 10
    assert score_toxicity(d.limit(0), learn_lexicon(d.limit(0), y)).count() == 0
    assert all(0 <= r.score <= 1 for r in score_quality(d, learn_quality(d, y.limit(0))).collect())


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r.score for r in score_quality(d, learn_quality(d, y)).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((rows[k] >= 0.5) == (k % 7 != 0) for k in held) >= 0.95 * len(held)


def test_pairwise_terms_by_sum_of_squares():
    rng = np.random.default_rng(0)
    model = FactorisationMachine(0.3, rng.normal(size=FEATURES), rng.normal(size=(FEATURES, 3)))
    row, feature, value = next(features([b"a b c a", b"", None]))
    raw, _ = model.raw(row, feature, value, 3)
    for k in range(3):
        f, x = feature[row == k], value[row == k]
        pairs = sum(model.factors[f[i]] @ model.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i + 1, len(f)))
        assert raw[k] == pytest.approx(0.3 + model.linear[f] @ x + pairs, rel=1e-6)


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), "END"]


class BruteAutomaton:
    """States, arcs and failure arcs in dictionaries, walked token by token."""

    def __init__(self, texts):
        self.n = Counter()
        for text in texts:
            w = ["END", *lm_tokens(text)]
            for k in range(1, len(w)):
                for order in range(1, language_model.ORDER + 1):
                    if k - order + 1 >= 0:
                        self.n[tuple(w[k - order + 1 : k + 1])] += 1
        self.total = sum(n for x, n in self.n.items() if len(x) == 1)
        self.distinct = sum(len(x) == 1 for x in self.n)

    def root(self, y):
        return (self.n[(y,)] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def arc(self, state, y):
        if not state:
            return self.root(y)
        beta = language_model.BETA[len(state) - 1]
        return (self.n[(*state, y)] + beta * self.arc(state[1:], y)) / (self.n[state] + beta)

    def walk(self, text):
        w, score, failed = ["END", *lm_tokens(text)], 0.0, 0
        for k in range(1, len(w)):
            state = tuple(w[max(0, k - language_model.ORDER + 1) : k])
            while state and not self.n[state]:
                state = state[1:]
            while state and not self.n[(*state, w[k])]:  # failure arcs
                score += math.log10(language_model.BETA[len(state) - 1] / (self.n[state] + language_model.BETA[len(state) - 1]))
                state, failed = state[1:], failed + 1
            score += math.log10(self.arc(state, w[k]))
        return score, failed


@pytest.mark.parametrize(("block", "shard", "order"), [(1 << 20, 1 << 22, 3), (16, 64, 3), (50, 1000, 2), (64, 512, 4)])
def test_language_model_matches_a_walked_automaton(spark, monkeypatch, block, shard, order):
    monkeypatch.setattr(language_model, "BLOCK", block)
    monkeypatch.setattr(language_model, "SHARD", shard)
    monkeypatch.setattr(language_model, "_STRETCH", 4 * block)
    monkeypatch.setattr(language_model, "_WALK", max(2, block // 3))
    monkeypatch.setattr(language_model, "ORDER", order)
    monkeypatch.setattr(language_model, "BETA", (3.0, 1.5, 0.7))
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(["The", "the", "cat", "sat", "on", *WORDS[:40]], weights=[9, 9, 5, 5, 5, *[1] * 40], k=rng.randint(0, 40)))) for k in range(150)]
    docs += [(k, " ".join(f"{x} then-{x}" for x in rng.choices([f"w{j}" for j in range(1500)], k=30))) for k in range(150, 200)]
    docs += [(900, None), (901, ""), (902, "unseen unheard the"), (902, "unseen unheard the"), (903, "the cat sat " * 70)]
    rows = score_texts(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n_tokens string, row int").repartition(3)).collect()
    assert len(rows) == len(docs)
    brute = BruteAutomaton([t for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1])
    texts = dict(docs)
    for r in rows:
        w = lm_tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(brute.n[(x,)] > 0 for x in w), brute.total)
        assert r.base_score == pytest.approx(sum(math.log10(brute.root(x)) for x in w), abs=1e-9)
        score, failed = brute.walk(texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-9) and r.n_failed == failed
    assert brute.root("unheard of") + sum(brute.root(x[0]) for x in brute.n if len(x) == 1) == pytest.approx(1)
    state = (b"the",) if order == 2 else (b"the", b"cat")
    assert brute.n[state] and brute.arc(state, "unheard of") + sum(brute.arc(state, x[0]) for x in brute.n if len(x) == 1) == pytest.approx(1)


def test_language_model_asks_one_order_at_a_time(spark, monkeypatch):
    """A pass has the n-grams of one order only, and its shuffle files are gone before the next one begins."""
    import time

    from memlattice.llm.common import Scratch

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles().iterator()
        return {f.getName() for f in iter(lambda: files.next() if files.hasNext() else None, None) if f.getName().startswith("shuffle_")}

    def none_since(before):
        end = time.time() + 10
        while shuffles() - before and time.time() < end:
            time.sleep(0.1)
        return not shuffles() - before

    passes, asked, append = [], [], Scratch.append

    def noted(self, df, name):
        before = shuffles()
        out = append(self, df, name)
        passes.append(none_since(before))
        asked.append({r[0] for r in out.selectExpr(f"shard % {language_model.ORDER}").distinct().collect()})
        return out

    monkeypatch.setattr(Scratch, "append", noted)
    docs = spark.createDataFrame([(k, "the cat sat on the mat " * 20) for k in range(40)], "doc_id long, text string").repartition(4)
    assert score_texts(docs).count() == 40
    assert passes == [True] * language_model.ORDER and asked == [{0}, {0, 1}, {0, 1, 2}]


def test_language_model_base_columns_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    sql = f"""
    WITH words AS (SELECT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end')) AS w FROM '{sf}/documents.parquet')
    SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL"""
    import duckdb

    rows = duckdb.sql(sql).fetchall()
    c = Counter()
    for doc, w, n in rows:
        c[w] += n * (zlib.crc32(str(doc).encode()) % 5 != 1)
    c = Counter({w: n for w, n in c.items() if n})
    total, distinct = sum(c.values()), len(c)
    want = defaultdict(lambda: [0, 0, 0.0])
    for doc, w, n in rows:
        want[doc][0] += n
        want[doc][1] += n * (c[w] > 0)
        want[doc][2] += n * math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1)))
    got = language_model.op6_lm_scoring(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r.n_tokens, r.n_known] == want[r.doc_id][:2] and r.train_tokens == total
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)


def test_language_model_learns_word_order(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BETA", (1.0, 1.0))
    rng = random.Random(9)
    docs = [(k, " ".join(f"{x} then-{x}" for x in rng.choices(WORDS[:30], k=20))) for k in range(200)]
    held = [r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_language_model_of_very_long_texts_and_of_nothing(spark):
    """Three million equal tokens: sums neither wrap nor lose the pieces."""
    docs = spark.createDataFrame([(1, "a " * 3_000_000), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in score_texts(docs).collect()}
    assert rows[1].n_tokens == 3_000_001 and -10 < rows[1].base_score < 0 and -10 < rows[1].score < 0
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(["x"] * rng.randint(0, 50)), rng.choice(["a"] * 20 + ["b", "b", "c", None]), 1) for k in range(600)]
    docs += [(0, None, "a", 1), (0, None, "a", 1), (None, "x y", None, 1), (700, "z " * 9000, "a", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, rank int")
    rows = mix_sources(frame, block=64).collect()
    assert len(rows) == len(docs)
    size, taken, target, total = defaultdict(int), defaultdict(int), {}, 0
    for r in rows:
        assert r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        total += r.size
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert all(r.source_size == size[r.source] for r in rows)
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    again = mix_sources(frame.repartition(7), block=64).collect()
    key = lambda r: str(tuple(r))
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert mix_sources(frame.limit(0)).count() == 0
    assert {r.taken for r in mix_sources(frame.filter("text is null")).collect()} == {0}


@pytest.mark.parametrize(("least", "block", "chunk"), [(32, 8192, 1 << 24), (8, 200, 512)])
def test_neighbours(spark, monkeypatch, least, block, chunk):
    """With production settings a third of 500 vectors is reranked; smaller ones use many blocks and chunks."""
    for name, value in (("LEAST", least), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x[7] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [1.0]), (1100, [None] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(*r, 1, None) for r in rows], "vec_id long, embedding array<float>, v int, score double")
    got = nearest(frame, F.col("vec_id") % 50 == 0).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 500, 50):
        score = unit @ unit[q]
        score[q] = -9
        want = sorted(range(500), key=lambda k: (-score[k], k))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in mine} & set(want))
        assert all(r.score == pytest.approx(score[r.vec_id]) for r in mine)
    assert hits >= 45
    assert {r.query_id for r in got} == set(range(0, 500, 50))
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_copies_and_repeated_ids(spark):
    """Equal vectors tie to the smaller id; a repeated id is one query and as many candidates."""
    rows = [(k, [1.0, 2.0]) for k in range(60)] + [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (100, [-1.0, 0.5])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50, 100)}
    assert found == {0: [1, 2, 3, 4, 5], 50: [0, 0, 1, 2, 3], 100: [0, 0, 1, 2, 3]}
    two = spark.createDataFrame([(0, [1.0]), (1, [-3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, -1.0)]


def test_neighbours_recall_by_the_index_alone(spark):
    """At ten times the size, a tenth of each block is reranked."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    x = {i: np.array(v, float) for i, v in duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()}
    ids = np.array(sorted(x))
    unit = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    got = defaultdict(set)
    for r in neighbours.op9_nearest_neighbours(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in got:
        score = unit @ unit[np.searchsorted(ids, q)]
        score[ids == q] = -9
        hits += len(got[q] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert len(got) == sum(ids % 50 == 0) and hits >= 0.95 * 5 * len(got)


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "and"), (1, 3, "assistant", "bétter"), (1, 3, "assistant", "bétter"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (3, 0, None, None), (None, 0, "user", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {(r.kind, r.chosen_id, r.rejected_id): r for r in preferences.format_pairs(preferences.derive_pairs(frame)).collect()}
    assert set(rows) == {("stale", 1, 1), ("sibling", 1, 2)}
    stale = rows["stale", 1, 1]
    assert stale.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\ngood<|end|>\n<|user|>\nand<|end|>\n" and stale.n_common == 3
    assert [stale.chosen_text[m.start : m.end] for m in stale.chosen_mask] == ["bétter<|end|>\n"]
    assert [stale.rejected_text[m.start : m.end] for m in stale.rejected_mask] == ["good<|end|>\n"]
    sibling = rows["sibling", 1, 2]
    assert sibling.n_common == 1 and [sibling.chosen_text[m.start : m.end] for m in sibling.chosen_mask] == ["good<|end|>\n", "bétter<|end|>\n"]
    empty = spark.createDataFrame([(None, [("user", "x")])], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    one = preferences.format_pairs(empty).first()
    assert (one.prompt, one.chosen_text, one.n_common) == ("", "", 0)
    assert preferences.derive_pairs(frame.limit(0)).count() == 0


def test_a_common_opening_is_dealt_to_many_tasks(spark):
    """900 of 2,400 conversations open alike: each but the best is paired with the best, once, and no task gets many of them."""
    rows = []
    for k in range(2400):
        rows += [(k, 0, "user", "hi" if k < 900 else f"q{k // 2}"), (k, 1, "assistant", "x" * (k * 7 % 1000))]
    pairs = preferences.derive_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = sorted((r.chosen_id, r.rejected_id) for r in pairs.filter("kind = 'sibling'").select("chosen_id", "rejected_id").collect())
    groups = {}
    for k in range(2400):
        groups.setdefault("hi" if k < 900 else k // 2, []).append(k)
    want = []
    for ids in groups.values():
        best = max(ids, key=lambda k: (k * 7 % 1000, -k))
        want += [(best, k) for k in ids if k != best]
    assert got == sorted(want)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(opening" in plan and "part#" in plan.split("hashpartitioning(opening")[-1].split(")")[0]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "size", "taken"} <= set(out.columns)
    assert 0 < out.count() < docs.count()
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() > 0.8 * docs.count()


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts, no rows, and columns whose names the operators use themselves."""
    import corpus_pipeline

    docs, labels = corpus(120)
    item = " ".join(f"q{k}" for k in range(20))
    common = "\n".join(["a line that all share", "own"])
    rows = [(*d[:2], "src") for d in docs] + [(200, None, "src"), (201, "", None), (201, "", None), (None, "no id " * 9, "x"), (202, "word " * 60_000, "x"), (203, item, "x"), (None, item, "x"), *((300 + k, f"{common} {k}", "y") for k in range(12))]
    frame = spark.createDataFrame([(*r, k, k, "g", "n") for k, r in enumerate(rows)], "doc_id long, text string, source string, rank int, row int, gone string, node string")
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        out = stages[name](spark, frame, str(tmp_path))
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        left = out.collect()
        ids = {r.doc_id for r in left}
        assert {200, 201, 202} <= ids and sum(r.doc_id == 201 for r in left) >= (1 if name == "near_dedup" else 2)
        assert stages[name](spark, frame.limit(0), str(tmp_path)).count() == 0
        if name == "toxicity":
            assert 0 not in ids and 1 in ids
        elif name == "line_dedup":
            assert len(left) == len(rows) and all(r.text == f"own {r.doc_id - 300}" for r in left if (r.doc_id or 0) >= 300)
        elif name == "near_dedup":
            assert sum(r.doc_id is None for r in left) == 2
        else:
            assert 203 not in ids and sum(r.doc_id is None for r in left) == 1 and len(left) == len(rows) - 2
    mixed = stages["mixing"](spark, frame, str(tmp_path)).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 3 * r.size for r in mixed)


def test_lexicon_follows_its_counts(spark):
    """Terms, their evidence and weights against a plain count over the sample."""
    from memlattice.llm import toxicity as tox

    docs, labels = corpus(300, seed=8)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    lexicon = learn_lexicon(d, y)
    held_in = {k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    counts = {0: Counter(), 1: Counter()}
    totals = Counter()
    for (k, text, *_), (_, _, label) in zip(docs, labels, strict=True):
        if k in held_in:
            totals[label] += 1
            words = set(fold(text))
            counts[label].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in tox.PREFIXES if len(w) >= n})
    share = totals[1] / (totals[0] + totals[1])
    assert lexicon.entries
    for term, weight in lexicon.entries.items():
        t, c = counts[1][term], counts[0][term]
        assert t > 2 and t / (t + c) > share
        assert weight == pytest.approx(min(8.0, math.log((t + 0.5) / (totals[1] + 1)) - math.log((c + 0.5) / (totals[0] + 1))))
    again = learn_lexicon(d.repartition(5), y.repartition(3))
    assert again == lexicon
    text = "a loser and w1 w2"
    words = fold(text)
    hits = find_hits(words, lexicon.automaton())
    x = sum(s * e for s, e in zip(lexicon.slopes, tox.evidence(words, hits), strict=True)) + lexicon.shift
    one = score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), lexicon).first()
    assert one.score == pytest.approx(1 / (1 + math.exp(-x))) and one.n_words == len(words) and one.n_hits == len(hits)


def test_quality_fits_agree(spark, monkeypatch):
    """Reruns agree whatever the order of rows; a bound on bytes leaves fewer rows."""
    from memlattice.llm import quality

    docs, labels = corpus(200, seed=4)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    one, two = learn_quality(d, y), learn_quality(d.repartition(7), y.repartition(2))
    assert one.bias == two.bias and (one.linear == two.linear).all() and (one.factors == two.factors).all()
    monkeypatch.setattr(quality, "LEARNED_BYTES", 2000)
    assert learn_quality(d, y).bias != one.bias


def test_golden_points_are_exact(spark):
    from memlattice.llm.mixing import GOLDEN, golden_point

    ids = [0, 1, 12345, 2**31, 4_000_000_000, 2**40 + 77, 2**62 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "j long").select(golden_point(F.col("j")).alias("p")).collect()
    assert [r.p for r in got] == [i * GOLDEN % 2**32 for i in ids]


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs, labels = corpus(60)
    more = [(k, f"copy {n} of a text", "en", "s", 1) for k in range(0, 60, 5) for n in range(200)]
    y = spark.createDataFrame(labels, LABELS)
    sample = labelled_sample(spark.createDataFrame([*docs, *more], DOCS), y, "toxic", 1000).collect()
    assert len(sample) == len(labelled_sample(spark.createDataFrame(docs, DOCS), y, "toxic", 1000).collect())
    assert sorted(map(tuple, sample)) == sorted(map(tuple, labelled_sample(spark.createDataFrame([*more, *docs], DOCS), y, "toxic", 1000).collect()))


def test_one_large_text_leaves_the_others_to_learn_from(spark, monkeypatch):
    """Texts that come first in the order of the hash and don't fit are left out, and only they."""
    docs, labels = corpus(200)
    plain = learn_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    monkeypatch.setattr(quality, "LEARNED_BYTES", 200_000)
    monkeypatch.setattr(quality, "LONGEST", 50_000)
    large = [(1000 + k, f"{k} " * 30_000, "en", "s", 1) for k in range(8)]
    known = [(1000 + k, 0, 0) for k in range(8)]
    model = learn_quality(spark.createDataFrame([*docs, *large], DOCS), spark.createDataFrame([*labels, *known], LABELS))
    assert np.array_equal(model.linear, plain.linear) and np.array_equal(model.factors, plain.factors) and np.abs(model.linear).max() > 0
