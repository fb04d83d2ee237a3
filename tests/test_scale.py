"""Results that hold on larger tables: exact where a bound or an approximation was, alike however the rows are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.functions import chunks, pages
from memlattice.operators import analytics as an
from memlattice.operators import clusters as cl
from memlattice.operators import communities as co
from memlattice.operators import graph
from memlattice.operators import relations as rl
from memlattice.operators import simjoin as sj
from memlattice.operators import temporal as tp
from memlattice.operators.graph import Rounds
from memlattice.plans import catalogue
from memlattice.sources import tables


@pytest.mark.parametrize("block", [7, 2048])
def test_close_vectors_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(sj, "VECTORS", block)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 4)) * 0.7
    points[10:20] = points[3]  # copies
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(points)]
    df = spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in cl.close_vectors(df, 1.15).collect()}
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for k in range(60):
        near = [j for j in range(60) if j != k and far[k, j] <= 1.15]
        other = [(round(far[k, j], 6), j) for j in near if rows[j][1] != rows[k][1]]
        best = min(other, default=(None, None))
        assert (got[k].first, got[k].n_close, got[k].nearest) == (3 if 10 <= k < 20 else k, len(near), best[1])
        assert got[k].distance == (pytest.approx(best[0]) if other else None)
    assert (got[99].first, got[99].n_close, got[99].nearest) == (99, 0, None) and len(got) == 61


def test_days_of_many_values_have_exact_quantiles(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(20_000)]
    rows = spark.createDataFrame([("d", v) for v in values] + [("e", None), ("d", None), ("f", 2.0)], "day string, ms double")
    got = {r.day: (r.p50, r.p95) for r in an.exact_quantiles(rows, ["day"], "ms", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"d": (sorted(values)[9_999], sorted(values)[18_999]), "f": (2.0, 2.0)}


def test_low_confidence_is_ordered_as_shown(spark, tmp_path):
    prices = {9: 50_000.0, 3: 50_000.1, 5: 40_000.0}  # 0.1 and 0.1000002 are shown alike
    rows = [(k, 1, "O", v, "1-URGENT", None) for k, v in prices.items()]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate timestamp_ntz"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.decision_id for r in catalogue.QUERIES["belief_low_confidence"](spark, str(tmp_path)).collect()] == [5, 3, 9]


def test_titles_keep_cut_references():
    read = lambda title: pages.head_of(f"<html><head><title>{title}</title></head></html>", "http://x/y", ("amp",))[0]
    assert read("a&amp; b&quot; &amp") == "a& b&quot; &amp"
    assert read("R&D &am") == "R&D &am"
    assert read("a" * 499 + " b") == "a" * 499
    assert pages.head_of("<title>a&amp; b&quot;</title>", "http://x/y")[0] == 'a& b"'


@pytest.mark.parametrize("ranks", [3, 32])
def test_capacity_passes_do_not_grow_the_plan(spark, ranks):
    """Twelve centroids and little room: lists end, chosen places are lost again, and the loop's result comes out."""
    rng = np.random.default_rng(11)
    points = rng.normal(size=(120, 3))
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(points)]
    centroids = {k: rows[k][1] for k in range(12)}
    far = ((points[:, None] - points[None, :12]) ** 2).sum(axis=2)
    order, want = np.argsort(far, axis=1, kind="stable"), [None] * 120
    for rank in range(12):
        for k in range(120):
            if want[k] is None and want.count(order[k, rank]) < 9:
                want[k] = int(order[k, rank])
    saved = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sj.capacity_clusters(df, centroids, 9, lambda x: saved.append(1) or Rounds(spark).save(x), ranks).collect()
    assert [r.cluster for r in sorted(got)] == want
    assert len(saved) < 24  # a table for each list and the result, none for a pass


def test_simple_paths_read_stored_hops(spark, tmp_path):
    """Parallel edges and either direction; every length reads what the hops before wrote, not the edges again."""
    kinds = "src string, dst string, edge_type string"
    rows = [("A", "B", "X"), ("A", "B", "Y"), ("C", "B", "X"), ("C", "D", "X"), ("A", "D", "X"), ("D", "D", "X")]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/edges")
    out = graph.simple_paths(spark.read.parquet(f"{tmp_path}/edges"), "A", "D", 3)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A>D"), (3, "A>B>C>D")]
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]


@pytest.mark.parametrize("strategy", ["sentence", "paragraph", "recursive", "markdown", "semantic"])
def test_texts_are_cut_a_few_at_a_time(spark, monkeypatch, strategy):
    monkeypatch.setattr(chunks, "SLICE", 3)
    texts = [None, "", *[f"Red cats {k} run fast. Red cats run again!\n\nBlue dogs sleep. " * (k % 4) for k in range(20)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.c for r in rows.select("doc_id", chunks.chunks(F.col("text"), strategy, 60, 10).alias("c")).collect()}
    cut = chunks.chunked(rows, "text", strategy, 60, 10)
    assert {r.doc_id: r.chunks for r in cut.collect()} == want and len(want) == 22 and any(want.values())
    assert cut.columns == ["doc_id", "chunks"]


def test_edge_pairs_get_tasks_by_their_number(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, tables.Tables(spark, sf).edges.collect()))
    items = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "ROWS", -(-items // 7))
    edges = tables.Tables(spark, sf).edges
    assert sorted(map(str, edges.collect())) == want
    assert edges._jdf.queryExecution().optimizedPlan().toString().count(", 7\n") + edges._jdf.queryExecution().executedPlan().toString().count(", 7)") >= 2


def test_hops_and_triples_get_tasks_by_their_number(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    rows = tables.Tables(spark, sf).edge_rows
    assert rows >= tables.Tables(spark, sf).edges.count()
    monkeypatch.setattr(tables, "ROWS", -(-rows // 9))
    plan = catalogue.QUERIES["set_relation_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert ", 9)" in plan


def test_hops_gather_only_edges_at_the_frontier(spark, monkeypatch):
    plans = []
    save = Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df))
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "b", "Y"), ("b", "c", "X"), ("c", "a", "X")], "src string, dst string, edge_type string")
    assert sorted(tuple(r) for r in graph.reach(edges, "a", 2).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert plans and all(p.count("Aggregate") == 1 for p in plans)


@pytest.mark.parametrize("arcs", [3, 8_000_000])
def test_betweenness_walks_many_sources_at_once(spark, monkeypatch, arcs):
    """Sources that no edge enters keep their own edges: only those beyond a path's first count for what may travel."""
    rng = random.Random(2)
    pairs = {(f"o{k}", f"p{rng.randrange(6)}") for k in range(40) for _ in range(3)} | {(f"p{rng.randrange(6)}", f"s{rng.randrange(4)}") for _ in range(12)} | {("s0", "p1"), ("s1", "s1"), ("s2", "r"), ("s3", "r"), ("o1", "r")}
    monkeypatch.setattr(graph, "ADJACENCY", sum(not a.startswith("o") for a, _ in pairs))
    monkeypatch.setattr(graph, "ARCS", arcs)
    monkeypatch.setattr(graph, "_betweenness_by_joins", None)  # too many edges to travel, if those of o0 to o39 did
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    ends = sorted({x for pair in pairs for x in pair})
    far = {x: {x: (0, 1)} for x in ends}  # from x: hops and shortest paths
    for x in ends:
        level = [x]
        for hops in range(1, len(ends)):
            met = {}
            for a, b in pairs:
                if a in level and b not in far[x]:
                    met[b] = met.get(b, 0) + far[x][a][1]
            far[x] |= {b: (hops, k) for b, k in met.items()}
            level = list(met)
    through = lambda a, v, b: far[a][v][1] * far[v][b][1] / far[a][b][1] if v in far[a] and b in far[v] and far[a][v][0] + far[v][b][0] == far[a][b][0] else 0.0
    want = {v: sum(through(a, v, b) for a in ends for b in far[a] if len({a, v, b}) == 3) / ((len(ends) - 1) * (len(ends) - 2)) for v in ends}
    nodes = spark.createDataFrame([(x,) for x in ends], "item_id string")
    assert {r.item_id: r.betweenness for r in graph.betweenness(edges, nodes).collect()} == pytest.approx(want)


def test_betweenness_brings_no_rows_to_the_driver(spark, monkeypatch):
    """Names and edges come as Arrow: as rows they were Python objects, which the driver's memory did not hold."""
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "F"), ("D", "A"), ("E", "A")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEF"], "item_id string")
    with monkeypatch.context() as m:
        for name in ("toPandas", "collect", "toLocalIterator"):
            m.setattr(type(edges), name, None)
        m.setattr(graph, "_betweenness_by_joins", None)
        found = graph.betweenness(edges, nodes)
    assert {r.item_id: r.betweenness * 20 for r in found.collect()} == pytest.approx({"A": 8.0, "B": 2.0, "C": 2.0, "D": 8.0, "E": 0.0, "F": 0.0})


@pytest.mark.parametrize("crowd", [3, 2_000])
def test_intervals_of_few_rows_are_not_repeated(spark, monkeypatch, crowd):
    monkeypatch.setattr(tp, "CROWD", crowd)
    rng = random.Random(4)
    rows = [(k, k % 5 if k < 20 else 9, s, None if rng.random() < 0.2 else s + rng.randrange(-20, 900)) for k in range(60) for s in (rng.randrange(2000),)] + [(60, None, 5, 9), (61, 9, None, None)]
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c)).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "id int, k int, s int, e int").select("id", "k", day("s").alias("s"), day("e").alias("e"))
    if crowd == 2_000:
        monkeypatch.setattr(F, "sequence", lambda *_: F.raise_error(F.lit("a row was repeated")).cast("array<bigint>"))
    out = tp.interval_join(df, df, ["k"], "s", "e", 7).filter("id < id_b")
    meets = lambda a, b: a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and (b[3] is None or a[2] < b[3]) and (a[3] is None or b[2] < a[3])
    assert sorted((r.id, r.id_b) for r in out.collect()) == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meets(a, b)]


def test_edge_joins_get_tasks_by_the_edges(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 10)
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "b", "X"), ("b", "z", "X"), ("b", " ", "X"), ("c", "b", "Y"), ("c", "a", "Y")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "s")], "item_id string, memory_type string")
    schemas = spark.createDataFrame([("X", "s", "t"), ("Y", "s", "t")], "edge_type string, source_type string, target_type string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    known, problems = graph.insert_edges(edges, nodes, 90), rl.edge_problems(edges, nodes, schemas, 90)
    merged = graph.merge_nodes(edges, spark.createDataFrame([("b", "a")], "old_id string, new_id string"), 90)
    assert all("(item_id" in plan(x) and ", 9)" in plan(x) for x in (known, problems)) and ", 9)" in plan(merged)
    assert "BroadcastHashJoin" in plan(merged) and "SortMergeJoin" not in plan(merged)
    assert sorted(tuple(r) for r in known.collect()) == [("a", "b", "X"), ("a", "b", "X"), ("c", "a", "Y"), ("c", "b", "Y")]
    assert sorted((r.src, r.dst, r.problem or "") for r in problems.collect()) == [("a", "b", ""), ("a", "b", ""), ("b", " ", "blank id"), ("b", "z", "missing end"), ("c", "a", "not allowed"), ("c", "b", "")]
    assert sorted(tuple(r) for r in merged.collect()) == [("a", " ", "X"), ("a", "z", "X"), ("c", "a", "Y")]


@pytest.mark.parametrize("labels", [0, 1_000_000])
def test_components_contract_their_edges(spark, monkeypatch, labels):
    """Chains in and out of order, a star, copies, loops, ends without nodes: each round has fewer edges, few rounds in all."""
    monkeypatch.setattr(graph, "LABELS", labels)
    saved = []
    save = Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df: saved.append(1) or save(self, df))
    rng = random.Random(6)
    ids = list(range(100, 140))
    rng.shuffle(ids)
    pairs = [(k, k + 1) for k in range(40)] + list(zip(ids, ids[1:])) + [(299, k) for k in range(200, 230)] + [(299, 299), (299, 200), (400, 401), (500, None)]
    edges = spark.createDataFrame([(a, b, "X") for a, b in pairs], "src long, dst long, edge_type string")
    nodes = [*range(41), *range(100, 140), *range(200, 230), 299, 300, 400, 500]
    got = {r.item_id: r.component for r in graph.connected_components(spark.createDataFrame([(k,) for k in nodes], "item_id long"), edges).collect()}
    assert got == {k: 0 if k < 41 else 100 if k < 140 else 200 if k < 300 else k for k in nodes}
    assert len(saved) <= 32


def test_communities_do_not_shuffle_ways_to_few_labels(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.createDataFrame([(a + k, b + k) for k in (0, 10, 20) for a in range(4) for b in range(a)] + [(0, 10), (10, 20)], "src long, dst long")
        labels = co.louvain(links)
        assert {r.item_id: r.community for r in labels.collect()} == {k + a: k for k in (0, 10, 20) for a in range(4)}
        plan = co.community_metrics(links, labels)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_propagation_gets_tasks_by_the_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 1)
    used = []
    save = Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df: used.append(spark.conf.get("spark.sql.shuffle.partitions")) or save(self, df))
    edges = spark.createDataFrame([("a", "b", "X"), ("c", "b", "X"), ("d", "e", "X")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "item_id string")
    got = {r.item_id: r.community for r in graph.label_communities(nodes, edges, 1).collect()}
    assert got == {"a": "b", "b": "a", "c": "b", "d": "e", "e": "d", "f": "f"}
    assert used == ["4", "6", "6"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"


@pytest.mark.parametrize("rounds", [1, 2, 3, 4])
def test_propagation_shuffles_messages_once_a_round(spark, monkeypatch, rounds):
    """Edges to and from nodes that don't exist, null ends, loops, parallel and reverse edges, a node twice: as by loops; a table
    has one shuffle of messages, and one of nodes."""
    rng = random.Random(rounds)
    pairs = [(rng.choice("abcdefghijklmnoxyz"), rng.choice("abcdefghijklmnoxyz")) for _ in range(45)] + [("a", "a"), ("b", "a"), ("a", "b"), ("p", "x"), ("q", None), (None, "b")]
    nodes = [*"abcdefghijklmnopq", "c", "c", "h"]
    ways = {w for a, b in pairs for w in ((a, b), (b, a)) if a and b}
    want = {x: x for x in nodes}
    for _ in range(rounds):
        votes = {x: {} for x in nodes}
        for a, b in ways:
            if a in want and b in want:
                votes[b][want[a]] = votes[b].get(want[a], 0) + nodes.count(a)
        want = {x: min(v, key=lambda c: (-v[c], c)) if v else want[x] for x, v in votes.items()}
    plans = []
    save = Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    edges = spark.createDataFrame([(a, b, "X") for a, b in pairs], "src string, dst string, edge_type string")
    got = graph.label_communities(spark.createDataFrame([(x,) for x in nodes], "item_id string"), edges, rounds)
    assert sorted((r.item_id, r.community) for r in got.collect()) == sorted((x, want[x]) for x in nodes)
    assert all(p.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2 for p in plans)
    assert len(plans) == rounds + 2
