"""Clusters over the given tables: greedy seeds, capacity, near names and vectors, communities by modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators import clusters as cl
from memlattice.operators import communities as co
from memlattice.operators import graph as g
from memlattice.operators import simjoin as sj
from memlattice.sources.tables import Tables

from .registry import query

#: In SQL, the fold of (a, b) pairs in order: what joins no earlier seed is one.
_FOLD = """steps AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS i, list(a) AS near FROM pairs GROUP BY b
), walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS followers, NULL::BIGINT AS b, NULL::BIGINT AS seed
  UNION ALL
  SELECT i, CASE WHEN seed IS NULL THEN followers ELSE list_append(followers, b) END, b, seed
  FROM (SELECT s.i, s.b, w.followers, list_min(list_filter(s.near, lambda a: NOT list_contains(w.followers, a))) AS seed FROM walk w JOIN steps s ON s.i = w.i + 1)
)"""
_SETS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"
_JACCARD = "len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))"
#: What a document is called: its first sentence.
_NAMES = f"names AS (SELECT doc_id, name, {_SETS.format('name')} AS s FROM (SELECT doc_id, split_part(text, '.', 1) AS name FROM documents WHERE text IS NOT NULL))"
_ALIKE = f"SELECT x.doc_id AS a, y.doc_id AS b FROM names x JOIN names y ON x.doc_id < y.doc_id AND len(x.s) > 0 AND list_has_any(x.s, y.s) AND {_JACCARD} >= 0.6"


def _names(t: Tables) -> DataFrame:
    name = F.split_part("text", F.lit("."), F.lit(1))
    return t.documents.filter("text is not null").select("doc_id", name.alias("name"), sj.words(name).alias("s"))


@query("seq_greedy_clusters", f"""
WITH RECURSIVE sets AS (SELECT p_brand, p_partkey, {_SETS.format("p_name")} AS s FROM part
), pairs AS MATERIALIZED (SELECT x.p_partkey AS a, y.p_partkey AS b FROM sets x JOIN sets y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey AND {_JACCARD} >= 0.3
), {_FOLD}
SELECT p_brand, p_partkey, coalesce(seed, p_partkey) AS cluster FROM part LEFT JOIN walk ON b = p_partkey""")
def seq_greedy_clusters(t: Tables) -> DataFrame:
    """Parts of a brand by the words of their names, in the order of their keys."""
    return cl.greedy(t.part.select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_name", "p_partkey", 0.3)


@query("set_hybrid_dedup", f"WITH RECURSIVE {_NAMES}, pairs AS MATERIALIZED ({_ALIKE}), {_FOLD} SELECT doc_id, coalesce(seed, doc_id) AS kept FROM names LEFT JOIN walk ON b = doc_id")
def set_hybrid_dedup(t: Tables) -> DataFrame:
    """Documents by their names: equal sets of words first, then similar ones, each kept under the first it is like."""
    named = _names(t).withColumn("all", F.lit(1))
    return cl.greedy(named, ["all"], "name", "doc_id", 0.6).select("doc_id", F.col("cluster").alias("kept"))


@query("set_name_pairs", f"WITH {_NAMES}, first AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM names GROUP BY list_sort(s)) SELECT a, b FROM ({_ALIKE.replace('names', 'first')})")
def set_name_pairs(t: Tables) -> DataFrame:
    """Pairs of different names that share three fifths of their words."""
    return sj.jaccard_pairs(_names(t), "doc_id", "s", 0.6).select("a", "b")


_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {0}"


@query("set_label_clusters_embedding", f"WITH RECURSIVE pairs AS MATERIALIZED ({_NEAR.format(0.35)}), {_FOLD} SELECT vec_id, coalesce(seed, vec_id) AS cluster FROM embeddings LEFT JOIN walk ON b = vec_id")
def set_label_clusters_embedding(t: Tables) -> DataFrame:
    """Vectors joined to the first cluster whose first member is near, in order."""
    return cl.greedy_vectors(t.embeddings, 0.35)


@query("set_vector_dedup", f"SELECT vec_id, least(vec_id, coalesce(min(a), vec_id)) AS kept FROM embeddings LEFT JOIN ({_NEAR.format(0.35)}) ON b = vec_id GROUP BY vec_id")
def set_vector_dedup(t: Tables) -> DataFrame:
    return cl.near_vectors(t.embeddings, 0.35)


@query("set_global_clusters", f"""
WITH RECURSIVE {_NAMES}, ways AS MATERIALIZED (SELECT a, b FROM ({_ALIKE}) UNION ALL SELECT a, b FROM ({_NEAR.format(0.4)}) WHERE a IN (SELECT doc_id FROM names) AND b IN (SELECT doc_id FROM names)
), edges2 AS MATERIALIZED (SELECT a, b FROM ways UNION SELECT b, a FROM ways
), reach AS (SELECT doc_id, doc_id AS met FROM names UNION SELECT r.doc_id, w.b FROM reach r JOIN edges2 w ON r.met = w.a
), grouped AS (SELECT doc_id, min(met) AS cluster FROM reach GROUP BY doc_id)
SELECT doc_id, cluster, max(struct_pack(n := length(name), name := name)) OVER (PARTITION BY cluster).name AS canonical FROM grouped JOIN names USING (doc_id)""")
def set_global_clusters(t: Tables) -> DataFrame:
    """Documents with similar names or vectors, merged under the longest name (ties: the last)."""
    names = _names(t)
    classes = sj.set_classes(names, "doc_id", "s", []).filter(F.size("tokens") > 0).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).filter("a < b")
    known = names.select("doc_id")
    near = sj.cosine_pairs(t.embeddings.join(known.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi"), 0.4)
    pairs = classes.union(sj.jaccard_pairs(names, "doc_id", "s", 0.6).select("a", "b")).union(near)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("NEAR").alias("edge_type"))
    found = g.connected_components(known.withColumnRenamed("doc_id", "item_id"), edges).select(F.col("item_id").alias("doc_id"), F.col("component").alias("cluster"))
    rows = found.join(names.select("doc_id", "name"), "doc_id")
    top = rows.groupBy("cluster").agg(F.max(F.struct(F.length("name").alias("n"), "name")).alias("top")).select("cluster", F.col("top.name").alias("canonical"))
    return rows.select("doc_id", "cluster").join(top, "cluster").select("doc_id", "cluster", "canonical")


@query("set_kmeans_clusters")
def set_kmeans_clusters(t: Tables) -> DataFrame:
    return cl.kmeans(t.embeddings, 50)



@query("set_capacity_clusters", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ranked AS (SELECT v.vec_id, c.vec_id AS c, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_sum(list_transform(range(1, len(v.e) + 1), lambda k: (v.e[k] - c.e[k]) ** 2)), c.vec_id) AS r FROM v, (SELECT * FROM v WHERE vec_id % 50 = 0 AND vec_id < 500) c
), walk AS (
  SELECT vec_id, NULL::BIGINT AS cluster, 0::BIGINT AS r FROM v
  UNION ALL
  SELECT vec_id, CASE WHEN cluster IS NOT NULL THEN cluster WHEN taken + k <= 40 THEN bid END, r + 1
  FROM (SELECT w.vec_id, w.cluster, w.r, b.c AS bid, coalesce(n.taken, 0) AS taken, row_number() OVER (PARTITION BY b.c, w.cluster IS NULL ORDER BY w.vec_id) AS k
        FROM walk w JOIN ranked b ON b.vec_id = w.vec_id AND b.r = w.r + 1 LEFT JOIN (SELECT cluster AS at, count(*) AS taken FROM walk WHERE cluster IS NOT NULL GROUP BY cluster) n ON n.at = b.c)
)
SELECT vec_id, cluster FROM walk WHERE r = (SELECT max(r) FROM walk)""")
def set_capacity_clusters(t: Tables) -> DataFrame:
    """Vectors in clusters of forty at most around ten of them; who bids too late has none."""
    centroids = {r["vec_id"]: list(r["embedding"]) for r in t.embeddings.filter((F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 500)).select("vec_id", "embedding").collect()}
    return sj.capacity_clusters(t.embeddings, centroids, 40, g.Rounds(t.spark).save, ranks=4)


@query("graph_knowledge_clusters")
def graph_knowledge_clusters(t: Tables) -> DataFrame:
    """Communities of the users' links by modularity, with density and strength."""
    found = co.louvain(t.links)
    out = co.community_metrics(t.links, found)
    return out.select("community", "n", "n_edges", F.round("density", 6).alias("density"), F.round("strength", 6).alias("strength"))
