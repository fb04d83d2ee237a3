"""Each operator against a brute-force version, and on awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memlattice.llm.common import hash_words, shingle_hashes
from memlattice.llm.decontaminate import contamination, exact_matches, proximity_matches
from memlattice.llm.line_dedup import apply_bitmaps, dedup_lines, line_bitmaps
from memlattice.llm.near_dedup import near_duplicates, trees_for
from memlattice.llm.secrets import BASE, MORE, build_index, candidates, find_secrets, trigram_query

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def awkward(rng, n=60):
    """Rows with nulls, empty and long texts, repeated rows, copies and near copies."""
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    base = rng.choices(WORDS, k=100)
    for k in range(12):
        near = list(base)
        near[rng.randrange(100)] = f"x{k}"
        texts.append(" ".join(near))
    texts += [texts[0], texts[0].upper(), "", None, "\n\n", " \t ", "one", "one", "Ünï cödé é", " ".join(rng.choices(WORDS, k=5000))]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, "null id", None, None, None)]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = word_list(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_word_hashes_follow_words():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices("abAB é\t\n\x1c x", k=rng.randint(0, 60)))
        words = word_list(text)
        hashes = hash_words(text.encode()).tolist()
        assert len(hashes) == len(words)
        assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
        assert len(shingle_hashes(hash_words(text.encode()), 3)) == len(shingles(text, 3))


def test_near_duplicates_match_brute_force(spark):
    rows = awkward(random.Random(1))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()}
    named = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = {k: shingles(t, 4) for k, t in named.items()}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    want = {(k, len(sets[k]), group[k], group[k] == k) for k in sets} | {(None, 1, None, True)}
    assert got == want
    assert len({g for g in group.values()}) < len(group) - 10


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trees_for(0.8, 0.9999) > trees_for(0.8, 0.9) > 1


def test_large_group_goes_through_branching(spark, monkeypatch):
    from memlattice.llm import near_dedup

    monkeypatch.setattr(near_dedup, "NODE", 8)
    rng = random.Random(3)
    base = rng.choices(WORDS, k=150)
    rows = []
    for k in range(80):
        near = list(base)
        near[rng.randrange(150)] = f"y{k}"
        rows.append((k, " ".join(near), "en", "s", 1))
    got = {r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0}


@pytest.mark.parametrize("dense", [0, 1000])
def test_second_round_finds_what_the_first_left(spark, monkeypatch, dense):
    """A hub with fifty near copies that are not near each other: most name others than the hub first."""
    from memlattice.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PARTNERS", 1)
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    rng = random.Random(11)
    hub = [f"h{k}" for k in range(200)]
    rows = [(0, " ".join(hub))]
    for k in range(1, 51):
        near = list(hub)
        for at in rng.sample(range(200), 3):
            near[at] = f"z{k}-{at}"
        rows.append((k, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: shingles(t, 5) for k, t in rows}
    near = {k for k in sets if 5 * len(sets[k] & sets[0]) >= 4 * len(sets[k] | sets[0])}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert len(near) > 40 and all(got[k] == 0 for k in near)


def test_large_star_is_compared_whole(spark, monkeypatch):
    """A hub of 300 spokes, each about 0.81 to it and 0.67 to the others, with nodes of 64."""
    from memlattice.llm import near_dedup

    monkeypatch.setattr(near_dedup, "NODE", 64)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    rng = random.Random(5)
    hub = [f"h{k}" for k in range(100)]
    rows = [(0, " ".join(hub))]
    for k in range(1, 301):
        near = list(hub)
        for at in (rng.randrange(5, 45), rng.randrange(55, 95)):
            near[at] = f"z{k}-{at}"
        rows.append((k, " ".join(near)))
    sets = {k: shingles(t, 5) for k, t in rows}
    near = {k for k in sets if 5 * len(sets[k] & sets[0]) >= 4 * len(sets[k] | sets[0])}
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 250 and all(got[k] == 0 for k in near)


def test_pairs_in_a_crowd_with_common_boilerplate(spark, monkeypatch):
    """120 pairs of similarity over 0.8 among 240 documents of about 0.7 to each other, with nodes of 8."""
    from memlattice.llm import near_dedup

    monkeypatch.setattr(near_dedup, "NODE", 8)
    rng = random.Random(12)
    common = [f"b{k}" for k in range(170)]
    rows = []
    for k in range(120):
        own = [f"o{k}-{j}" for j in range(20)]
        for copy in range(2):
            tail = [f"t{k}-{copy}-{j}" for j in range(14)]
            rows.append((2 * k + copy, " ".join(common + own + tail)))
    rng.shuffle(rows)
    sets = {k: shingles(t, 5) for k, t in rows}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert all(near(2 * k, 2 * k + 1) for k in range(120)) and not near(0, 2)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in range(240)}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = set()
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                who = phrases.get(tuple(w[k : k + n]))
                if who:
                    hit.update(range(k, k + n))
                    found |= who
        out.add((doc, len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices(WORDS[:30], k=rng.choice([1, 3, 12, 13, 14, 40])))) for k in range(12)]
    items += [(20, items[5][1]), (21, ""), (22, None), (23, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (24, "never seen words")]
    docs = [(k, " ".join(rng.choices(WORDS[:30], k=rng.randint(0, 200)))) for k in range(60)]
    for k in range(20):
        w = rng.choices(WORDS, k=50)
        at = rng.randrange(50)
        docs.append((100 + k, " ".join(w[:at]) + "," + items[k % 12][1].upper() + "! " + " ".join(w[at:])))
    docs += [(200, ""), (201, None), (202, " ".join(["w1"] * 40)), (203, "é" + items[3][1])]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got.collect()} == brute_contamination(docs, items)


def test_contamination_counts_words_by_splitting(spark):
    """Any ends, ASCII's borders and beyond it; no word is matched by a regular expression."""
    texts = [None, "", " ", "...", "a", " a", "a ", ".A1b.", "x\ny\t\tz", "É é-ü", "\u00a0", "a\x7fb", "`a{Z[", "/0:9@", "\x00q\x00", "😀 ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = contamination(docs, spark.createDataFrame([(1, "nothing of it")], "item_id long, text string"))
    want = {k: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_words for r in out.collect()} == want
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_contamination_of_awkward_tables(spark):
    rows = awkward(random.Random(4))
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "item_id")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).filter("n_hit > 0 or contaminated").count() == 0
    one = spark.createDataFrame([(None, "null id"), (1, "one")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit, r.n_items) for r in contamination(docs, one).collect() if r.n_hit}
    assert (None, 2, 0) in got and len([x for x in got if x[1:] == (1, 1)]) == 2
    assert contamination(docs.limit(0), one).count() == 0


def test_pipeline_removes_contaminated_rows_by_id_and_text(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (7, item), (7, "also clean"), (8, None)], "doc_id long, text string")
    left = {tuple(r) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert left == {(None, "clean"), (7, "also clean"), (8, None)}


def test_exact_and_proximity_matches_give_places(spark):
    bench = spark.createDataFrame([(7, " ".join(f"term{k}" for k in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"term{k}" for k in range(15))), (2, " ".join(f"term{k}" for k in reversed(range(20))))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.first, r.last) for r in exact_matches(docs, bench).collect()] == [(1, 7, 2, 16)]
    # the rarer half are the five words that the first document lacks, and five others
    assert {r.doc_id for r in proximity_matches(docs, bench).collect()} == {2}
    assert {(r.doc_id, r.n_near) for r in contamination(docs, bench, near=True).collect()} == {(1, 0), (2, 1)}


def test_proximity_matches_follow_their_definition(spark):
    rng = random.Random(21)
    items = [(k, " ".join(rng.choices(WORDS[:60], k=rng.choice([1, 4, 7, 20, 40])))) for k in range(8)] + [(8, None), (9, "neverseen words only here today ok")]
    docs = [(k, "," * (k % 2) + " ".join(rng.choices(WORDS[:60], k=rng.randint(0, 120)))) for k in range(40)] + [(50, None), (51, "")]
    places = {}
    for doc, text in docs:
        for pos, w in enumerate(re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)) if text is not None else ():
            places.setdefault(w, []).append((doc, pos))
    want = set()
    for item, text in items:
        known = sorted((len(places[w]), w) for w in set(bench_words(text)) if w in places)
        half = -(-len(known) // 2)
        if half < 3:
            continue
        seen = {}
        for _, w in known[:half]:
            for doc, pos in places[w]:
                for block in (pos // 20, pos // 20 - 1):
                    seen.setdefault((doc, block), set()).add(w)
        want |= {(doc, item) for (doc, _), ws in seen.items() if len(ws) >= min(8, half)}
    got = proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 5


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup_matches_brute_force(spark, keep_first):
    rng = random.Random(6)
    rows = [(k, "\n".join(rng.choice(["common", " Common\t", f"own {k}", "", "rare" + str(k % 9), "a" * 40]) for _ in range(rng.randint(0, 70)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "\n"), (None, "common\nx"), rows[3], *((7, f"twice\nown text {k}") for k in range(12)), *((None, f"nameless\n{k}") for k in range(12))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, b_keep string")
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    distinct = list(dict.fromkeys(rows))
    holders = {}
    for r in distinct:
        for x in {key(y) for y in (r[1] or "").split("\n")}:
            holders.setdefault(x, set()).add(r[0])
    common = {x for x, who in holders.items() if x and len(who - {None}) >= 10}
    seen, kept = set(), {}
    for doc, text in sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0)):  # (equal ids share no common line here)
        stay = []
        for line in (text or "").split("\n"):
            if key(line) not in common or (keep_first and key(line) not in seen):
                stay.append(line)
            if key(line) in common:
                seen.add(key(line))
        kept[doc, text] = ((text or "").count("\n") + 1, (text or "").count("\n") + 1 - len(stay), "\n".join(stay))
    got = apply_bitmaps(docs, line_bitmaps(docs, keep_first=keep_first)).collect()
    assert len(got) == len(rows)
    assert {(r["row"].doc_id, r["row"].text): (r.n_lines, r.n_dropped, r.kept) for r in got} == kept


def test_line_dedup_keeps_columns(spark):
    docs = spark.createDataFrame(awkward(random.Random(7)), SCHEMA)
    docs = docs.withColumnRenamed("source", "_n").withColumn("keep", F.lit(1)).withColumn("text_hash", F.lit("x"))
    out = dedup_lines(docs, min_docs=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.doc_id: r.n_chars for r in out.collect() if r.doc_id is not None} == {r.doc_id: None if r.text is None else len(r.text) for r in out.collect() if r.doc_id is not None}
    assert dedup_lines(docs.limit(0)).count() == 0


def brute_spans(text):
    out = []
    for k, (pattern, group, least) in enumerate(((r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end()))
    return [(BASE[k].kind, a, b) for a, k, b in sorted(out)]


def test_secrets_match_brute_force(spark):
    rng = random.Random(8)
    parts = ["password", "PASSWD", "Token", "api_key", "apikey", "APIKEY", "=", ": ", '"', " ", "é", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "abc", "x.y-z_w+q/r=", "secret", "K"]
    parts += ["eyJ", "eyJhbGciOi.eyJzdWIiOi.sig-nature"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(300)] + ["eyJ" * 200_000, None, "", "a" * 100_000, "AKIA" * 9, "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop"]
    frame = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, spans array<int>")
    got = find_secrets(frame).collect()
    assert find_secrets(frame.limit(0)).count() == 0
    base = {r.kind for r in BASE}
    found = 0
    for r in got:
        want = brute_spans(texts[r.doc_id])
        found += len(want)
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] == want
    assert len(got) == len(texts) and found > 100


def test_trigram_queries_never_lose_a_match():
    assert trigram_query(r"[0-9a-f]+") is None
    assert trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    texts = ["xx api_key=1", "apikey", "nothing", "akia", "PassWord", "", "ä", "ap", "i_key"]
    wanted = sorted({t for r in BASE + MORE if (q := trigram_query(r.pattern)) for x in q for t in x})
    assert {t: r.tolist() for t, r in build_index(texts, wanted).items()} == {t: [k for k, x in enumerate(texts) if t in x.lower()] for t in wanted}
    assert all(len(r) == 0 for r in build_index([], wanted).values())
    query = trigram_query(BASE[0].pattern)
    index = build_index(texts, sorted({t for q in query for t in q}))
    assert {k for k, t in enumerate(texts) if re.search(BASE[0].pattern, t)} <= set(candidates(query, index, len(texts)).tolist())


@pytest.mark.parametrize("n", [9, 10])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeated_line_over_many_splits(spark, n, keep_first):
    """A document's repeated line counts once, however the intermediate tables are split when they are read."""
    hadoop, was = spark.sparkContext._jsc.hadoopConfiguration(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    hadoop.set("parquet.block.size", "4096")
    hadoop.set("parquet.page.size", "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        docs = spark.createDataFrame([(k, "\n".join(["x"] * 20_000 + [f"own {k}"])) for k in range(n)], "doc_id long, text string")
        out = apply_bitmaps(docs, line_bitmaps(docs, keep_first=keep_first)).select("row.doc_id", "n_dropped", "kept").collect()
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size")
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    for r in out:
        gone = 0 if n < 10 else 20_000 - (keep_first and r.doc_id == 0)
        assert r.n_dropped == gone and r.kept == "\n".join(["x"] * (20_000 - gone) + [f"own {r.doc_id}"])
    assert len(out) == n


@pytest.mark.parametrize("keep_first", [False, True])
def test_many_common_lines_without_a_broadcast_of_all(spark, monkeypatch, keep_first):
    from memlattice.llm import line_dedup

    rng = random.Random(12)
    rows = [(k, "\n".join(["hot"] * rng.randint(1, 5) + rng.choices([f"line {j}" for j in range(60)], k=12))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, apply_bitmaps(docs, line_bitmaps(docs, keep_first=keep_first)).select("row.doc_id", "n_dropped", "kept").collect()))
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(line_dedup, "_HOT", 0.05)
    assert sorted(map(tuple, apply_bitmaps(docs, line_bitmaps(docs, keep_first=keep_first)).select("row.doc_id", "n_dropped", "kept").collect())) == want
    assert sum(n for _, n, _ in want) > 300
