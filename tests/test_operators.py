"""Literal fixtures for the memory-graph operators."""

import pytest
from pyspark.sql import functions as F

from memlattice.functions import plugins, scores
from memlattice.functions import text as tx
from memlattice.operators import analytics, clusters, dedup, graph, relations, search, temporal
from memlattice.sources import corpus


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = spark.createDataFrame([("A", "semantic"), ("B", "semantic"), ("C", "episodic"), ("D", "semantic"), ("E", "working")], "item_id string, memory_type string")
    edges = spark.createDataFrame([("A", "B", "RELATES_TO"), ("A", "C", "RELATES_TO"), ("B", "D", "CAUSES"), ("C", "D", "CAUSES")], "src string, dst string, edge_type string")
    return nodes, edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_diamond_aggregates(diamond):
    nodes, edges = diamond
    assert rows(graph.orphans(nodes, edges).select("item_id")) == [("E",)]
    assert rows(graph.degrees(nodes, edges)) == [("A", 2), ("B", 2), ("C", 2), ("D", 2), ("E", 0)]
    assert rows(graph.edge_type_counts(edges)) == [("CAUSES", 2), ("RELATES_TO", 2)]
    assert rows(graph.two_hop(edges, "RELATES_TO", "CAUSES")) == [("A", "B", "D"), ("A", "C", "D")]


def test_diamond_paths(diamond):
    nodes, edges = diamond
    assert rows(graph.simple_paths(edges, "A", "D")) == [(2, "A>B>D"), (2, "A>C>D")]
    assert rows(graph.shortest_path(edges, "D", "A")) == [(2, "D>B>A")]
    assert rows(graph.shortest_path(edges, "A", "E")) == []
    assert rows(graph.connected_components(nodes, edges)) == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A"), ("E", "E")]
    assert rows(graph.transitive_closure(edges, "CAUSES")) == []
    assert rows(graph.reach(edges, "A", 3)) == [("A", 0), ("B", 1), ("C", 1), ("D", 2)]
    got = {r.item_id: r.betweenness for r in graph.betweenness(edges, nodes).collect()}
    assert got["B"] == pytest.approx(0.5 / 12) and got["A"] == 0


def test_cycle_closure_and_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1, "X") for k in range(40)] + [(40, 0, "X")], "src long, dst long, edge_type string")
    assert graph.transitive_closure(edges, "X").count() == 41 * 40 - 41
    nodes = spark.createDataFrame([(k,) for k in range(41)], "item_id long")
    assert {r.component for r in graph.connected_components(nodes, edges).collect()} == {0}


def test_merge_and_delete(diamond):
    nodes, edges = diamond
    mapping = nodes.sparkSession.createDataFrame([("B", "A"), ("C", "A")], "old_id string, new_id string")
    assert rows(graph.merge_nodes(edges, mapping)) == [("A", "D", "CAUSES")]
    left, kept = graph.delete_nodes(nodes, edges, nodes.filter("item_id = 'B'"))
    assert left.count() == 4 and rows(kept.select("src", "dst")) == [("A", "C"), ("C", "D")]
    assert rows(graph.missing_reverse(edges, "CAUSES")) == [("D", "B"), ("D", "C")]


CORPUS = [
    (1, "Alice leads Project Atlas at Acme Corp"), (2, "Bob is the CTO of Acme Corp and reports to Alice"), (3, "Django is a Python web framework created by Adrian Holovaty"), (4, "Kubernetes orchestrates containerized workloads across clusters"),
    (5, "Always use async/await for database calls in Python"), (6, "React is a JavaScript UI library maintained by Meta"), (7, "The deployment failed at 3pm due to a DNS misconfiguration"),
]


def test_search(spark):
    items = spark.createDataFrame(CORPUS, "item_id long, content string")
    assert {r.item_id for r in search.contains_search(items, "acme corp").collect()} == {1, 2}
    assert search.contains_search(items, "*", 3).count() == 3
    assert [r.item_id for r in search.keyword_search(items, "python database calls").collect()] == [5]
    assert search.bm25(items, "django python").orderBy(F.desc("score")).first().item_id == 3
    assert {r.item_id for r in search.full_text(items, "acme corp alice").collect()} == {1, 2}
    lists = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "item_id long, rank int")
    assert [r.item_id for r in search.rrf(lists, 2).collect()] == [1, 3]


def test_text(spark):
    df = spark.createDataFrame([("See [[Page One|shown]] and [[Two]] ((idea)) #tag1 #tag2. More!",)], "t string")
    r = df.select(tx.wikilinks(F.col("t")).alias("w"), tx.concepts(F.col("t")).alias("c"), tx.hashtags(F.col("t")).alias("h"), tx.first_sentence(F.col("t")).alias("s"), tx.decompose(F.lit("cats and dogs, birds or fish; ox")).alias("d")).first()
    assert (r.w, r.c, r.h) == (["Page One", "Two"], ["idea"], ["tag1", "tag2"]) and r.s.endswith("#tag2.")
    assert r.d == ["cats and dogs, birds or fish; ox", "cats", "dogs", "birds"]
    one = df.select(tx.relation_type(F.lit("works for!")).alias("a"), tx.relation_type(F.lit("9 lives")).alias("b"), tx.relation_type(F.lit("--")).alias("c"), tx.positional_similarity(F.lit("abcd"), F.lit("abxd")).alias("p"), tx.character_chunks(F.lit("abcdefghij"), 4, 1).alias("k"), tx.sentiment(F.lit("good good bad")).alias("m"))
    assert tuple(one.first()) == ("WORKS_FOR", "REL_9_LIVES", "UNKNOWN", 0.75, ["abcd", "defg", "ghij"], pytest.approx(1 / 3))
    with pytest.raises(ValueError):
        tx.character_chunks(F.lit("a"), 3, 3)


def test_scores(spark):
    one = spark.range(1)
    r = one.select(scores.reinforced(F.lit(0.5), F.lit(2)), scores.contradicted(F.lit(0.8), F.lit(1)), scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))), scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))), scores.stability(F.lit(0), F.lit(0)), scores.hebbian_boost(F.lit(30))).first()
    assert tuple(r) == (pytest.approx(0.595), pytest.approx(0.68), 0.0, 0.0, 0.5, 0.3)


@pytest.mark.parametrize(("ops", "want"), [(["add", "update"], "add"), (["add", "delete"], None), (["update", "update"], "update"), (["update", "delete"], "delete"), (["delete", "add"], "add"), (["delete", "update"], "delete")])
def test_coalesce(spark, ops, want):
    df = spark.createDataFrame([("x", k, o) for k, o in enumerate(ops)], "id string, at long, operation string")
    assert [r.operation for r in temporal.coalesce_mutations(df, ["id"], ["at"]).collect()] == ([want] if want else [])


def test_intervals(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-03-01"), (2, "2024-02-01", None), (3, "2024-03-01", "2024-03-02"), (4, "2023-01-01", "2023-01-05")], "id long, s string, e string").select(F.lit(1).alias("k"), "id", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    assert rows(temporal.interval_join(df, df, ["k"], "s", "e", 7).filter("id < id_b").select("id", "id_b")) == [(1, 2), (2, 3)]


def test_anchored_groups_measure_from_the_first(spark):
    df = spark.createDataFrame([(1, k, m) for k, m in enumerate([0, 40, 80, 90, 300])], "u long, id long, m long").select("u", "id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ts"))
    assert rows(temporal.anchored_groups(df, ["u"], "ts", 3600, "id").select("size", "first_id")) == [(2, 0), (2, 2)]


def test_relations(spark):
    rel = spark.createDataFrame([("Works At", "person", "org"), ("likes", "person", "food")], "predicate string, source_type string, target_type string")
    aliases = spark.createDataFrame([("works-at", "employed_by")], "alias string, canonical string")
    out = relations.normalise(rel, aliases)
    assert rows(out.select("predicate", "canonical", "match")) == [("Works At", "employed_by", 1.0), ("likes", "related_to", 0.0)]
    priors = spark.createDataFrame([("person", "employed_by", "org"), ("person", "eats", "food")], "source_type string, canonical string, target_type string")
    assert rows(relations.validate_pairs(out, priors).select("predicate", "pair_score")) == [("Works At", 1.0), ("likes", 0.5)]
    entities = spark.createDataFrame([("e", "T", {"n": "x", "m": "a|b"})], "entity_id string, entity_type string, props map<string,string>")
    rules = spark.createDataFrame([("T", "n", True, "number", None, "one", True), ("T", "m", False, "string", None, "one", False), ("T", "z", True, "string", None, "one", True)], "entity_type string, property string, required boolean, kind string, allowed array<string>, cardinality string, hard boolean")
    assert rows(relations.constraint_violations(entities, rules)) == [("e", "m", "cardinality", False), ("e", "n", "type", True), ("e", "z", "missing", True)]


def test_dedup_and_analytics(spark):
    df = spark.createDataFrame([(1, "Acme Corp", "org", 0.5, "x"), (2, "acme  corp", "ORG", 0.9, None)], "id long, name string, kind string, confidence double, note string")
    r = dedup.dedup_entities(df, dedup.canonical_key(F.col("name"), F.col("kind")), "confidence", "id").first()
    assert (r.id, r.n_merged, r.note, r.confidence) == (2, 2, "x", 0.9)
    values = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0)], "k string, v double")
    assert analytics.gini(values, ["k"], "v").first().gini == pytest.approx(1 / 3, abs=1e-6)
    p = spark.createDataFrame([("a", 1), ("b", 1)], "w string, n long")
    assert analytics.jensen_shannon(p, p, "w").first().js == 0
    d = spark.range(1).select(*[c.alias(k) for k, c in dedup.map_diff(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))).items()]).first()
    assert (d.added, d.removed, d.changed) == (["c"], ["a"], ["b"])


def test_clusters(spark):
    df = spark.createDataFrame([("b", 1, "a b c d"), ("b", 2, "a b c e"), ("b", 3, "x y")], "block string, id long, t string")
    assert rows(clusters.greedy(df, ["block"], "t", "id", 0.5)) == [("b", 1, 1), ("b", 2, 1), ("b", 3, 3)]
    lists = spark.createDataFrame([(1, ["a", "b"], ["a", "c"])], "id long, old array<string>, new array<string>")
    assert rows(clusters.list_changes(lists, "id", "old", "new")) == [(1, "replace", 1, 2, 1, 2)]


def test_corpus_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("one", "semantic"), ("two", "episodic")], "content string, memory_type string")
    header = corpus.write_corpus(items, str(tmp_path / "c"), "test").first()
    back = corpus.read_corpus(spark, str(tmp_path / "c/records"))
    assert header.item_count == 2 and rows(back.select("content", "memory_type")) == [("one", "semantic"), ("two", "episodic")]
    text = spark.createDataFrame([("<triplet> Paris <subj> France <obj> capital of <triplet> A <subj> B <obj> r",)], "t string")
    assert [tuple(x) for x in text.select(corpus.triplets(F.col("t")).alias("x")).first().x] == [("Paris", "capital of", "France"), ("A", "r", "B")]
    files = spark.createDataFrame([("m.py", "import os\nclass A(B):\n    def f(self):\n        g()\n"), ("bad.py", "def (")], "path string, source string")
    found = rows(corpus.index_python(files, "r").select("kind", "dst"))
    assert ("INHERITS", "B") in found and ("CALLS", "g") in found and ("IMPORTS", "os") in found


def test_plugins(spark):
    registry = plugins.Registry()
    registry.register("enricher", "plus", lambda df: df.withColumn("x", F.col("id") + 1))
    with pytest.raises(ValueError):
        registry.register("enricher", "plus", lambda df: df)
    assert registry.names("enricher") == ["plus"] and plugins.compatible("1.4", ">=1.2,<2") and not plugins.compatible("2.0", "<2")
    line = plugins.Pipeline([("a", registry.get("enricher", "plus")), ("b", lambda df: df.withColumn("y", F.col("x") * 2))])
    assert line.run(spark.range(1), until="a").columns == ["id", "x"]
    assert line.resume().first().y == 2 and line.undo().columns == ["id", "x"]
    assert plugins.order_stages({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        plugins.order_stages({"a": ["b"], "b": ["a"]})


def test_greedy_clusters_of_a_large_block(spark):
    df = spark.createDataFrame([("b", k, f"w{k % 2100} x{k % 2100}") for k in range(4200)], "block string, id long, t string")
    assert all(r.cluster == r.id % 2100 for r in clusters.greedy(df, ["block"], "t", "id", 0.5).collect())


@pytest.mark.parametrize("adjacency, reached", [(0, 10**9), (0, 12), (1_000_000, 1)])
def test_betweenness_of_any_size(spark, monkeypatch, adjacency, reached):
    """A>B>D, A>C>D, D>F and D>A: B and C lie on half of what passes them, with the adjacency in tasks and joined, in one batch
    of sources and in three."""
    monkeypatch.setattr(graph, "ADJACENCY", adjacency)
    monkeypatch.setattr(graph, "REACHED", reached)
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "F"), ("D", "A")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEF"], "item_id string")
    got = {r.item_id: r.betweenness * 20 for r in graph.betweenness(edges, nodes).collect()}
    assert got == pytest.approx({"A": 4.0, "B": 1.0, "C": 1.0, "D": 7.0, "E": 0.0, "F": 0.0})


def test_graph_queries_take_the_whole_graph(spark):
    from memlattice.plans import catalogue
    from memlattice.sources.tables import Tables

    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    nodes = {r.item_id for r in t.nodes.collect()}
    got = catalogue.QUERIES["graph_betweenness"](spark, sf).collect()
    assert len(got) == len(nodes) and {r.item_id for r in got} == nodes
    assert any(r.betweenness > 0 for r in got if r.item_id.startswith("p:"))
    ways = {}
    for r in t.edges.collect():
        ways.setdefault(r.src, set()).add(r.dst)
        ways.setdefault(r.dst, set()).add(r.src)
    found, open_ = set(), [("c:1",)]
    for _ in range(5):
        open_ = [(*p, x) for p in open_ for x in ways[p[-1]] if x not in p]
        found |= {">".join(p) for p in open_ if p[-1] == "n:7"}
        open_ = [p for p in open_ if p[-1] != "n:7"]
    paths = [r.path for r in catalogue.QUERIES["graph_simple_paths_all"](spark, sf).collect()]
    assert len(paths) == len(set(paths)) and set(paths) == found


def test_tag_hubs_link_all_items_of_a_tag(spark, tmp_path):
    from memlattice.plans import catalogue

    spark.createDataFrame([(k, f"hot w{k % 40}" if k < 60 else f"own{k}") for k in range(61)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    held = {}
    for r in catalogue.QUERIES["graph_tag_hubs"](spark, str(tmp_path)).collect():
        held.setdefault(r.tag, set()).add(r.item_id)
    assert held["hot"] == set(range(60)) and held["w3"] == {3, 43} and "own60" not in held and "w30" not in held


def test_stage_sketches_roll_up_within_their_error(spark):
    import datetime as dt
    import random

    from memlattice.operators.analytics import roll_up, stage_sketches

    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=rng.randint(0, 86_399)), rng.choice("ab"), rng.expovariate(1.0)) for _ in range(30_000)]
    rows += [(start, "c", None), (None, "a", 1.0), (start, "one", 5.0)]
    events = spark.createDataFrame(rows, "at timestamp_ntz, stage string, ms double")
    parts = stage_sketches(events, "at", "stage", "ms", F.col("ms") > 3)
    assert parts.filter("stage = 'a'").count() > 200
    found = {r.stage: r for r in roll_up(parts, "1 day", {"p50": 0.5, "p99": 0.99}).collect()}
    for stage in "ab":
        values = sorted(v for at, s, v in rows if s == stage and at)
        r = found[stage]
        assert r.n == len(values) and r.most == values[-1] and r.error_rate == sum(v > 3 for v in values) / len(values)
        for q, got in ((0.5, r.p50), (0.99, r.p99)):
            assert abs(sum(v <= got for v in values) / len(values) - q) < 0.005
    assert found["c"].n == 1 and found["c"].p50 is None and found["one"].p99 == 5.0
    assert roll_up(parts.limit(0), "1 day", {"p50": 0.5}).count() == 0


def test_stored_index_searches_like_the_texts(spark, tmp_path):
    import random

    from memlattice.operators.textindex import TextIndex

    rng = random.Random(6)
    words = ["the", "The", "cat", "sat", "on", "mats", "école", *[f"w{k}" for k in range(60)]]
    rows = [(k, " ".join(rng.choices(words, weights=[30, 9, 5, 4, 9, 2, 2, *[1] * 60], k=rng.randint(1, 40)))) for k in range(200)] + [(900, ""), (901, "cat " * 5000)]
    items = spark.createDataFrame(rows, "item_id long, content string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(items.filter("item_id < 80"))
    index.add(items.filter("item_id >= 80"))
    index.add(items.limit(0))
    for text in ("cat the", "École w3 w59", "w1", "unknown", ""):
        want = {r.item_id: r.score for r in search.bm25(items, text).collect()}
        got = {r.item_id: r.score for r in index.bm25(text).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert {r.item_id for r in index.holding_all("cat The").collect()} == {k for k, t in rows if {"cat", "the"} <= set(t.lower().split())}
    plan = index.postings(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "EqualTo(term,cat)" in plan or "In(term, [cat])" in plan
