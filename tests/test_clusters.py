"""Similarity joins, clusters in parallel rounds and communities against plain loops, and on awkward rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.operators import clusters as cl
from memlattice.operators import communities as co
from memlattice.operators import simjoin as sj
from memlattice.operators.graph import Rounds


def jaccard(x, y):
    return len(x & y) / len(x | y) if x and y else 0.0


def fold(rows, near):
    """In order, each row joins the first seed of its block that is near, or becomes one."""
    seeds, out = {}, {}
    for block, key, value in sorted(rows, key=lambda r: r[1]):
        out[key] = next((k for k, v in seeds.get(block, []) if near(v, value)), None)
        if out[key] is None:
            seeds.setdefault(block, []).append((key, value))
            out[key] = key
    return out


def texts(rng, n=160):
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Eta", "theta"]
    rows = [(rng.choice(["x", "y", None]), k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for k in range(n)]
    return [*rows, ("x", 900, None), ("x", 901, ""), ("y", 902, "  "), ("x", 903, " ".join(f"w{j}" for j in range(500))), ("x", 904, " ".join(f"w{j}" for j in range(520)))]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_and_greedy_clusters_match_loops(spark, threshold):
    rows = texts(random.Random(4))
    sets = [(b, k, frozenset((t or "").lower().split())) for b, k, t in rows]
    df = spark.createDataFrame(rows, "blk string, k long, t string").repartition(3)
    least = {}
    for b, k, s in sorted(sets, key=lambda r: r[1]):
        least.setdefault((b, s), k)
    want = {(x[1], y[1]) for x in sets for y in sets if x[0] == y[0] and x[1] < y[1] and jaccard(x[2], y[2]) >= threshold and least[x[0], x[2]] == x[1] and least[y[0], y[2]] == y[1]}
    got = [(r.a, r.b) for r in sj.jaccard_pairs(df.withColumn("s", sj.words(F.col("t"))), "k", "s", threshold, ["blk"]).collect()]
    assert set(got) == want and len(got) == len(want)
    found = {r.k: r.cluster for r in cl.greedy(df, ["blk"], "t", "k", threshold).collect()}
    assert found == fold(sets, lambda x, y: jaccard(x, y) >= threshold)


def test_joins_of_nothing(spark):
    empty = spark.createDataFrame([], "blk string, k long, t string")
    assert cl.greedy(empty, ["blk"], "t", "k", 0.5).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cl.greedy_vectors(vectors, 0.5).count() == 0 == cl.kmeans(vectors, 5).count()
    assert co.louvain(spark.createDataFrame([], "src long, dst long")).count() == 0
    with pytest.raises(ValueError):
        sj.jaccard_pairs(empty, "k", "t", 0.0)


def test_q_grams(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,)], "t string").select(sj.q_grams(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in rows] == [["abc", "bca", "cab"], ["ab"], [], []]


def vectors_of(rng, n=150):
    rows = [(k, [round(x, 3) for x in rng.normal(size=6).tolist()]) for k in range(n)]
    return [*rows, (500, rows[3][1]), (501, rows[3][1]), (502, [0.0] * 6), (503, None)]


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_clusters_match_loops(spark, monkeypatch, block):
    monkeypatch.setattr(sj, "VECTORS", block)
    rows = vectors_of(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def near(x, y):
        return x is not None and y is not None and any(x) and any(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.6

    want = fold([("", k, v) for k, v in rows], near)
    assert {r.vec_id: r.cluster for r in cl.greedy_vectors(df, 0.6).collect()} == want
    known = [(k, v) for k, v in rows if v is not None]
    least = {k: min(j for j, w in known if j == k or near(v, w)) for k, v in known}
    assert {r.vec_id: r.kept for r in sj.near_vectors(df.filter("embedding is not null"), 0.6).collect()} == least


@pytest.mark.parametrize("block", [2048, 16])
def test_links_of_near_vectors_keep_their_copies(spark, monkeypatch, block):
    """Copies are linked to the least of them, zero, null and infinite vectors to none: components as by all pairs."""
    monkeypatch.setattr(sj, "VECTORS", block)
    rows = [*vectors_of(np.random.default_rng(5), 60), (504, [float("nan")] * 6), (505, [float("nan")] * 6), (506, [0.0] * 6), (507, [2 * x for x in vectors_of(np.random.default_rng(5), 60)[3][1]])]
    got = {(r.a, r.b) for r in sj.cosine_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6).collect()}
    near = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and any(x) and any(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.6}
    copies = {500, 501}
    assert got == {(a, b) for a, b in near if not {a, b} & copies} | {(3, 500), (3, 501)}


def test_global_clusters_link_copies_of_vectors(spark, tmp_path):
    """Document 1, the least of four with one vector, has no text; those with text are one cluster all the same."""
    import duckdb

    from memlattice.plans import catalogue

    texts = [(1, None), (2, "red. x"), (3, "blue. x"), (4, "green. x"), (5, "grey. x"), (6, "red. y"), (7, "")]
    vectors = [(k, [1.0, 0.0, 0.0]) for k in (1, 2, 3, 4)] + [(5, [0.0, 1.0, 0.0]), (6, [0.0, 0.0, 1.0]), (7, [-1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(db.sql(catalogue.ORACLES["set_global_clusters"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["set_global_clusters"](spark, str(tmp_path)).collect()) == want
    assert [r[1] for r in want] == [2, 2, 2, 5, 2, 7]


@pytest.mark.parametrize(("size", "ranks"), [(10, 32), (25, 2), (40, 3)])
def test_capacity_is_the_loop_over_ranks_and_ids(spark, size, ranks):
    rows = [(k, v) for k, v in vectors_of(np.random.default_rng(8)) if v is not None]
    centroids = {10 * k: rows[k][1] for k in range(5)}
    x = np.array([v for _, v in rows])
    far = np.stack([((x - np.array(c)) ** 2).sum(axis=1) for c in centroids.values()], axis=1)
    order, taken, want = np.argsort(far, axis=1, kind="stable"), Counter(), {k: None for k, _ in rows}
    for rank in range(len(centroids)):
        for k, (vec_id, _) in enumerate(rows):
            c = list(centroids)[order[k, rank]]
            if want[vec_id] is None and taken[c] < size:
                want[vec_id] = c
                taken[c] += 1
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in sj.capacity_clusters(df, centroids, size, Rounds(spark).save, ranks).collect()}
    assert got == want


def test_kmeans_clusters_hold_their_capacity(spark):
    rows = vectors_of(np.random.default_rng(1))
    sizes = Counter(r.cluster for r in cl.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect())
    assert sum(sizes.values()) == 153 and all(n <= 20 for c, n in sizes.items() if c < 7) and len(sizes) >= 7


@pytest.mark.parametrize(("places", "size", "ranks"), [(0, 9, 1), (0, 12, 3), (150, 9, 2), (600, 3, 1), (0, 0, 2)])
def test_capacity_by_stretches_is_the_loop(spark, monkeypatch, places, size, ranks):
    """Stretches of ranks alone, and a loop in one task over what they leave."""
    monkeypatch.setattr(sj, "PLACES", places)
    points = np.random.default_rng(12).normal(size=(130, 3)).round(2)
    points[40:60] = points[3]
    far = ((points[:, None] - points[None, :12]) ** 2).sum(axis=2)
    order, want = np.argsort(far, axis=1, kind="stable"), [None] * 130
    for rank in range(12):
        for k in range(130):
            if want[k] is None and want.count(10 * order[k, rank]) < size:
                want[k] = 10 * int(order[k, rank])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    got = sj.capacity_clusters(df, {10 * k: v for k, v in enumerate(points[:12].tolist())}, size, Rounds(spark).save, ranks).collect()
    assert [r.cluster for r in sorted(got)] == want


def test_kmeans_has_a_cluster_for_every_size_vectors(spark):
    """No number of clusters is the most, and copies of one vector fill as many: fewer than a cluster's size are left over."""
    many = spark.range(2100).selectExpr("id AS vec_id", "array(double(id % 7), double(id)) AS embedding")
    sizes = Counter(r.cluster for r in cl.kmeans(many, 2).collect())
    assert len(sizes) == 1050 and set(sizes.values()) == {2}
    copies = spark.range(103).selectExpr("id AS vec_id", "array(1.0D, 2.0D) AS embedding")
    assert Counter(r.cluster for r in cl.kmeans(copies, 20).collect()) == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, 5: 3}


def test_communities_of_planted_groups(spark):
    """Four dense groups of twelve, joined by a few edges."""
    rng = random.Random(2)
    edges = {(a, b) for g in range(4) for a in range(12 * g, 12 * g + 12) for b in range(a + 1, 12 * g + 12) if rng.random() < 0.7}
    edges |= {(12 * g, (12 * g + 13) % 48) for g in range(4)}
    df = spark.createDataFrame([*edges, (5, 5), (1, None), *[(b, a) for a, b in list(edges)[:20]]], "src long, dst long")
    labels = {r.item_id: r.community for r in co.louvain(df).collect()}
    assert labels == {k: 12 * (k // 12) for k in range(48)}
    metrics = {r.community: r for r in co.community_metrics(df, spark.createDataFrame(list(labels.items()), "item_id long, community long")).collect()}
    for g in range(4):
        n = len([1 for a, b in edges if a // 12 == b // 12 == g])
        r = metrics[12 * g]
        assert (r.n, r.n_edges) == (12, n) and r.density == pytest.approx(2 * n / 132) and r.strength == pytest.approx(12 * r.density)
    ways = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src long, dst long, w double")
    m, degree = len(edges), Counter(x for e in edges for x in e)
    want = sum(1 for a, b in edges if a // 12 == b // 12) / m - sum((sum(degree[k] for k in range(12 * g, 12 * g + 12)) / (2 * m)) ** 2 for g in range(4))
    assert co.modularity(ways, spark.createDataFrame([(k, c) for k, c in labels.items()], "node long, c long")) == pytest.approx(want)


@pytest.mark.parametrize("size", [3, 2048])
def test_interference_is_a_product_over_near_pairs_of_a_kind(spark, monkeypatch, size):
    monkeypatch.setattr(sj, "VECTORS", size)
    rng = np.random.default_rng(4)
    rows = [(k, ["hot", "hot", None, "b"][k % 4], [float(v) for v in rng.normal(size=4)]) for k in range(70)]
    rows += [(100, "hot", None), (101, "hot", []), (102, "hot", [0.0] * 4), (103, "hot", [1.0, 2.0]), (104, "hot", [float("nan"), 1.0, 1.0, 1.0]), (105, "hot", [float("inf"), 1.0, 1.0, 1.0]), (106, "hot", [1.0, None, 1.0, 1.0]), (107, "alone", [1.0] * 4)]
    got = {r.vec_id: (r.n, r.factor) for r in sj.interference(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), "label").collect()}
    want = {k: [0, 1.0] for k, _, _ in rows}
    for a, g, x in rows[:70]:
        for b, h, y in rows[:70]:
            c = np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
            if a != b and g == h and c > 0.3:
                want[a] = [want[a][0] + 1, want[a][1] * (1 - 0.05 * c)]
    assert got.keys() == want.keys() and all(got[k] == (n, pytest.approx(f)) for k, (n, f) in want.items())
