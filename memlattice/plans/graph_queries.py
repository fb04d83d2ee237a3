"""Queries over the property graph: scans, writes, neighbours, patterns, aggregates and iterative algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators import graph as g
from memlattice.sources.tables import Tables

from .registry import query

HUB = "n:7"


@query("scan_node_by_id", "SELECT * FROM nodes WHERE item_id = 'n:7'", "nodes")
def scan_node_by_id(t: Tables) -> DataFrame:
    return g.node_by_id(t.nodes, HUB)


@query("scan_all_nodes", "SELECT item_id, memory_type, name, round(weight, 6) AS weight FROM nodes", "nodes")
def scan_all_nodes(t: Tables) -> DataFrame:
    return t.nodes.withColumn("weight", F.round("weight", 6))


@query("scan_all_edges", "SELECT src, dst, edge_type FROM edges", "edges")
def scan_all_edges(t: Tables) -> DataFrame:
    return t.edges.select("src", "dst", "edge_type")


@query("scan_incident_edges", "SELECT src, dst, edge_type FROM edges WHERE src = 'n:7' OR dst = 'n:7'", "edges")
def scan_incident_edges(t: Tables) -> DataFrame:
    return g.incident_edges(t.edges, HUB).select("src", "dst", "edge_type")


@query("scan_neighbours", "SELECT item_id, memory_type, name FROM nodes WHERE item_id IN (SELECT dst FROM edges WHERE src = 'n:7' UNION SELECT src FROM edges WHERE dst = 'n:7')", "nodes edges")
def scan_neighbours(t: Tables) -> DataFrame:
    return g.neighbours(t.nodes, t.edges, HUB).select("item_id", "memory_type", "name")


@query("scan_counts", "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count", "nodes edges")
def scan_counts(t: Tables) -> DataFrame:
    return g.counts(t.nodes, t.edges)


@query("scan_node_types", "SELECT DISTINCT memory_type FROM nodes WHERE memory_type IS NOT NULL", "nodes")
def scan_node_types(t: Tables) -> DataFrame:
    return t.nodes.filter("memory_type is not null").select("memory_type").distinct()


@query("scan_edge_types", "SELECT DISTINCT edge_type FROM edges", "edges")
def scan_edge_types(t: Tables) -> DataFrame:
    return t.edges.select("edge_type").distinct()


@query("scan_events_since", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def scan_events_since(t: Tables) -> DataFrame:
    return t.events.filter("event_id > 5000").select("event_id", "user_id", "event_type")


@query("write_upsert_node", "SELECT user_id AS item_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1")
def write_upsert_node(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("item_id"), "event_type", "props", "ts", "event_id")
    return g.upsert_latest(rows, ["item_id"], [F.col("ts").alias("k1"), F.col("event_id").alias("k2")]).select("item_id", "event_type", "props")


@query("write_upsert_edge", """
WITH legs AS (SELECT *, 0 AS k FROM edges UNION ALL SELECT src, dst, edge_type, valid_to, NULL, 1 FROM edges WHERE edge_type = 'PLACED_BY')
SELECT src, dst, edge_type, coalesce(max(valid_from) FILTER (WHERE k = 1), max(valid_from) FILTER (WHERE k = 0)) AS valid_from, coalesce(max(valid_to) FILTER (WHERE k = 1), max(valid_to) FILTER (WHERE k = 0)) AS valid_to FROM legs GROUP BY 1, 2, 3""", "edges")
def write_upsert_edge(t: Tables) -> DataFrame:
    new = t.edges.filter("edge_type = 'PLACED_BY'").withColumn("valid_from", F.col("valid_to")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return g.upsert_edges(t.edges, new)


@query("write_bulk_edges", "SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT item_id FROM nodes WHERE memory_type <> 'part') AND dst IN (SELECT item_id FROM nodes WHERE memory_type <> 'part')", "nodes edges")
def write_bulk_edges(t: Tables) -> DataFrame:
    return g.insert_edges(t.edges, t.nodes.filter("memory_type <> 'part'"), t.edge_rows).select("src", "dst", "edge_type")


@query("write_delete_node", "SELECT src, dst, edge_type FROM edges WHERE src NOT IN (SELECT item_id FROM nodes WHERE memory_type = 'supplier') AND dst NOT IN (SELECT item_id FROM nodes WHERE memory_type = 'supplier')", "nodes edges")
def write_delete_node(t: Tables) -> DataFrame:
    return g.delete_nodes(t.nodes, t.edges, t.nodes.filter("memory_type = 'supplier'"))[1].select("src", "dst", "edge_type")


@query("write_delete_edge", "SELECT src, dst, edge_type FROM edges WHERE NOT (src LIKE 'n:%' AND dst = 'r:1' AND edge_type = 'LOCATED_IN')", "edges")
def write_delete_edge(t: Tables) -> DataFrame:
    gone = F.col("src").startswith("n:") & (F.col("dst") == "r:1") & (F.col("edge_type") == "LOCATED_IN")
    return t.edges.filter(~gone).select("src", "dst", "edge_type")


@query("write_merge_nodes", """
WITH m AS (SELECT item_id AS old_id, 'n:0' AS new_id FROM nodes WHERE memory_type = 'nation' AND item_id <> 'n:0'),
moved AS (SELECT coalesce(a.new_id, src) AS src, coalesce(b.new_id, dst) AS dst, edge_type, a.new_id IS NOT NULL OR b.new_id IS NOT NULL AS touched
          FROM edges LEFT JOIN m a ON src = a.old_id LEFT JOIN m b ON dst = b.old_id)
SELECT DISTINCT src, dst, edge_type FROM moved WHERE NOT (touched AND src = dst)""", "nodes edges")
def write_merge_nodes(t: Tables) -> DataFrame:
    mapping = t.nodes.filter("memory_type = 'nation' and item_id <> 'n:0'").select(F.col("item_id").alias("old_id"), F.lit("n:0").alias("new_id"))
    return g.merge_nodes(t.edges, mapping, t.edge_rows)


@query("write_rename_type", "SELECT CASE memory_type WHEN 'part' THEN 'product' ELSE memory_type END AS memory_type, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def write_rename_type(t: Tables) -> DataFrame:
    return t.nodes.replace({"part": "product"}, subset=["memory_type"]).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("write_merge_types", "SELECT CASE WHEN memory_type IN ('nation', 'region') THEN 'place' ELSE memory_type END AS memory_type, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def write_merge_types(t: Tables) -> DataFrame:
    return t.nodes.replace({"nation": "place", "region": "place"}, subset=["memory_type"]).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("write_delete_by_run", "SELECT src, dst, edge_type FROM edges WHERE dst NOT IN (SELECT 'p:'||p_partkey FROM part WHERE p_size = 1) AND src NOT IN (SELECT 'p:'||p_partkey FROM part WHERE p_size = 1)", "edges")
def write_delete_by_run(t: Tables) -> DataFrame:
    gone = t.part.filter("p_size = 1").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("item_id"))
    return g.delete_nodes(t.nodes, t.edges, gone)[1].select("src", "dst", "edge_type")


@query("write_server_edge_types", "SELECT DISTINCT regexp_replace(upper(event_type || ' of'), '[^A-Z0-9_]', '_', 'g') AS edge_type FROM events")
def write_server_edge_types(t: Tables) -> DataFrame:
    return t.events.select(F.regexp_replace(F.upper(F.concat("event_type", F.lit(" of"))), "[^A-Z0-9_]", "_").alias("edge_type")).distinct()


@query("write_dual_node", """
SELECT 'memory:'||p_partkey AS src, 'entity:'||lower(trim(p_brand)) AS dst, 'CONTAINS_ENTITY' AS edge_type FROM part
UNION ALL SELECT 'entity:'||lower(trim(p_brand)), 'memory:'||p_partkey, 'MENTIONED_IN' FROM part""")
def write_dual_node(t: Tables) -> DataFrame:
    m, e = F.concat(F.lit("memory:"), F.col("p_partkey").cast("string")), F.concat(F.lit("entity:"), F.lower(F.trim("p_brand")))
    return t.part.select(m.alias("src"), e.alias("dst"), F.lit("CONTAINS_ENTITY").alias("edge_type")).union(t.part.select(e, m, F.lit("MENTIONED_IN")))


@query("sink_graph_export", "SELECT item_id, n.memory_type, count(e.dst) AS n_out FROM nodes n LEFT JOIN edges e ON e.src = n.item_id GROUP BY ALL", "nodes edges")
def sink_graph_export(t: Tables) -> DataFrame:
    out = t.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    return t.nodes.join(out, F.col("item_id") == F.col("src"), "left").select("item_id", "memory_type", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"))


@query("join_two_hop", "SELECT a.src AS a, a.dst AS b, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src WHERE a.edge_type = 'PLACED_BY' AND b.edge_type = 'LOCATED_IN' AND a.src <> b.dst", "edges")
def join_two_hop(t: Tables) -> DataFrame:
    return g.two_hop(t.edges, "PLACED_BY", "LOCATED_IN")


@query("join_causal_transitivity", """
SELECT a.src AS a, b.dst AS c, 0.7::DOUBLE AS confidence FROM edges a JOIN edges b ON a.dst = b.src AND a.edge_type = 'LOCATED_IN' AND b.edge_type = 'LOCATED_IN'
WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM edges d WHERE d.src = a.src AND d.dst = b.dst AND d.edge_type = 'LOCATED_IN') GROUP BY 1, 2""", "edges")
def join_causal_transitivity(t: Tables) -> DataFrame:
    return g.infer_transitive(t.edges, "LOCATED_IN")


@query("join_contradiction_symmetry", """
WITH c AS (SELECT DISTINCT src, dst FROM links WHERE edge_type = 'error')
SELECT dst AS src, src AS dst FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.src = c.dst AND d.dst = c.src)""", "links")
def join_contradiction_symmetry(t: Tables) -> DataFrame:
    return g.missing_reverse(t.links, "error")


@query("join_topic_inheritance", "SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type = 'PLACED_BY'", "edges")
def join_topic_inheritance(t: Tables) -> DataFrame:
    return g.inherit(t.nodes, t.edges, "PLACED_BY", "INFLUENCES", "order", "customer")


@query("join_relation_endpoints", "SELECT src, dst FROM edges WHERE edge_type = 'PLACED_BY' AND src IN (SELECT item_id FROM nodes WHERE weight > 100000) AND dst IN (SELECT item_id FROM nodes WHERE weight > 0)", "nodes edges")
def join_relation_endpoints(t: Tables) -> DataFrame:
    rich = t.nodes.filter("weight > 100000").select(F.col("item_id").alias("src"))
    owed = t.nodes.filter("weight > 0").select(F.col("item_id").alias("dst"))
    return t.edges.filter("edge_type = 'PLACED_BY'").join(rich, "src", "left_semi").join(owed, "dst", "left_semi").select("src", "dst")


@query("join_backlinks", "SELECT DISTINCT n.item_id, n.memory_type FROM edges e JOIN nodes n ON n.item_id = e.src WHERE e.dst = 'n:7'", "nodes edges")
def join_backlinks(t: Tables) -> DataFrame:
    return g.neighbours(t.nodes, t.edges, HUB, direction="in").select("item_id", "memory_type")


@query("join_forward_links", "SELECT DISTINCT n.item_id, n.memory_type FROM edges e JOIN nodes n ON n.item_id = e.dst WHERE e.src = 'o:7'", "nodes edges")
def join_forward_links(t: Tables) -> DataFrame:
    return g.neighbours(t.nodes, t.edges, "o:7", direction="out").select("item_id", "memory_type")


@query("join_links_as_triples", "SELECT src AS item, edge_type AS relation, dst AS other FROM links WHERE src = 1 UNION ALL SELECT dst, edge_type, src FROM links WHERE dst = 1", "links")
def join_links_as_triples(t: Tables) -> DataFrame:
    return g.both_ways(t.links).filter("src = 1").select(F.col("src").alias("item"), F.col("edge_type").alias("relation"), F.col("dst").alias("other"))


@query("join_bidirectional_links", "SELECT src, dst, 'LINKS_TO' AS edge_type FROM links UNION ALL SELECT dst, src, 'LINKS_TO_BACK' FROM links", "links")
def join_bidirectional_links(t: Tables) -> DataFrame:
    return t.links.select("src", "dst", F.lit("LINKS_TO").alias("edge_type")).union(t.links.select("dst", "src", F.lit("LINKS_TO_BACK")))


@query("join_tag_related", """
SELECT DISTINCT b.item_id FROM tags a JOIN tags b ON a.tag = b.tag WHERE a.item_id = 1 AND b.item_id <> 1""", "tags")
def join_tag_related(t: Tables) -> DataFrame:
    mine = t.tags.filter("item_id = 1").select("tag")
    return t.tags.join(mine, "tag", "left_semi").filter("item_id <> 1").select("item_id").distinct()


@query("join_notes_by_tag", "SELECT item_id FROM tags WHERE tag = (SELECT min(tag) FROM tags)", "tags")
def join_notes_by_tag(t: Tables) -> DataFrame:
    return t.tags.join(t.tags.agg(F.min("tag").alias("tag")), "tag", "left_semi").select("item_id")


@query("join_outcome", "SELECT DISTINCT e.src FROM edges e JOIN nodes n ON n.item_id = e.dst WHERE e.edge_type = 'PLACED_BY' AND n.weight < 0", "nodes edges")
def join_outcome(t: Tables) -> DataFrame:
    bad = t.nodes.filter("weight < 0").select(F.col("item_id").alias("dst"))
    return t.edges.filter("edge_type = 'PLACED_BY'").join(bad, "dst", "left_semi").select("src").distinct()


@query("join_provenance", """
SELECT 'o:'||o_orderkey AS decision, (SELECT count(*) FROM edges e WHERE e.src = 'o:'||o_orderkey AND e.edge_type = 'PLACED_BY') AS produced,
       (SELECT count(*) FROM edges e WHERE e.src = 'o:'||o_orderkey AND e.edge_type = 'CONTAINS') AS derived FROM orders""", "edges")
def join_provenance(t: Tables) -> DataFrame:
    n = t.edges.filter("edge_type in ('PLACED_BY', 'CONTAINS')").groupBy("src").agg(F.count_if(F.col("edge_type") == "PLACED_BY").alias("produced"), F.count_if(F.col("edge_type") == "CONTAINS").alias("derived"))
    zero = F.lit(0).cast("long")
    return t.nodes.filter("memory_type = 'order'").join(n, F.col("item_id") == F.col("src"), "left").select(F.col("item_id").alias("decision"), F.coalesce("produced", zero).alias("produced"), F.coalesce("derived", zero).alias("derived"))


@query("join_provenance_gaps", "SELECT item_id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = item_id AND edge_type IN ('PLACED_BY', 'SUPPLIED_BY'))", "nodes edges")
def join_provenance_gaps(t: Tables) -> DataFrame:
    proven = t.edges.filter("edge_type in ('PLACED_BY', 'SUPPLIED_BY')").select(F.col("src").alias("item_id"))
    return t.nodes.join(proven, "item_id", "left_anti").select("item_id")


@query("agg_edge_type_counts", "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1", "edges")
def agg_edge_type_counts(t: Tables) -> DataFrame:
    return g.edge_type_counts(t.edges)


@query("agg_degree_map", "SELECT item_id, count(e.x) AS degree FROM nodes LEFT JOIN (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) e ON x = item_id GROUP BY 1", "nodes edges")
def agg_degree_map(t: Tables) -> DataFrame:
    return g.degrees(t.nodes, t.edges)


@query("agg_orphans", "SELECT item_id, memory_type FROM nodes WHERE item_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "nodes edges")
def agg_orphans(t: Tables) -> DataFrame:
    return g.orphans(t.nodes, t.edges).select("item_id", "memory_type")


@query("agg_health", """
WITH o AS (SELECT count(*) AS n FROM nodes WHERE item_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
d AS (SELECT count(*) AS n, count(*) FILTER (WHERE item_id IN (SELECT src FROM edges WHERE edge_type = 'PLACED_BY')) AS proven FROM nodes WHERE memory_type = 'order')
SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, o.n AS orphan_count,
  round(o.n / (SELECT count(*) FROM nodes), 6) AS orphan_ratio, round(d.proven / d.n, 6) AS provenance_coverage, o.n / (SELECT count(*) FROM nodes) < 0.2 AND d.proven / d.n > 0.5 AS healthy FROM o, d""", "nodes edges")
def agg_health(t: Tables) -> DataFrame:
    return g.health(t.nodes, t.edges, "order", ["PLACED_BY"])


@query("agg_most_connected", "SELECT src AS item_id, count(*) AS out_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "edges")
def agg_most_connected(t: Tables) -> DataFrame:
    return t.edges.groupBy(F.col("src").alias("item_id")).agg(F.count(F.lit(1)).alias("out_degree")).orderBy(F.desc("out_degree"), "item_id").limit(20)


@query("agg_prune_out_degree", "SELECT item_id FROM nodes WHERE (SELECT count(*) FROM edges WHERE src = item_id) < 3", "nodes edges")
def agg_prune_out_degree(t: Tables) -> DataFrame:
    n = t.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return t.nodes.join(n, F.col("item_id") == F.col("src"), "left").filter(F.coalesce("n", F.lit(0)) < 3).select("item_id")


@query("filter_prune_by_degree", "SELECT item_id FROM nodes LEFT JOIN (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) e ON x = item_id GROUP BY 1 HAVING count(e.x) <= 3", "nodes edges")
def filter_prune_by_degree(t: Tables) -> DataFrame:
    return g.degrees(t.nodes, t.edges).filter("degree <= 3").select("item_id")


@query("graph_components", "SELECT item_id, (SELECT min(item_id) FROM nodes) AS component FROM nodes WHERE (item_id IN (SELECT src FROM edges UNION SELECT dst FROM edges)) UNION ALL SELECT item_id, item_id FROM nodes WHERE item_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "nodes edges")
def graph_components(t: Tables) -> DataFrame:
    return g.connected_components(t.nodes, t.edges)


@query("graph_transitive_closure", """
WITH RECURSIVE c AS (SELECT src, dst FROM edges WHERE edge_type = 'LOCATED_IN' UNION SELECT c.src, e.dst FROM c JOIN edges e ON c.dst = e.src AND e.edge_type = 'LOCATED_IN')
SELECT src, dst FROM c WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = 'LOCATED_IN' AND e.src = c.src AND e.dst = c.dst)""", "edges")
def graph_transitive_closure(t: Tables) -> DataFrame:
    return g.transitive_closure(t.edges, "LOCATED_IN")


@query("graph_multi_hop", """
WITH RECURSIVE r AS (SELECT 'o:1' AS item_id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.item_id WHERE depth < 3)
SELECT item_id, min(depth) AS depth FROM r GROUP BY 1""", "edges")
def graph_multi_hop(t: Tables) -> DataFrame:
    return g.reach(t.edges, "o:1", 3)


@query("graph_causal_chain", """
WITH RECURSIVE r AS (SELECT 'o:1' AS item_id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.item_id AND e.edge_type IN ('PLACED_BY', 'LOCATED_IN') WHERE depth < 3)
SELECT item_id, min(depth) AS depth FROM r GROUP BY 1""", "edges")
def graph_causal_chain(t: Tables) -> DataFrame:
    return g.reach(t.edges, "o:1", 3, ["PLACED_BY", "LOCATED_IN"])


@query("graph_shortest_path", """
WITH RECURSIVE ways AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)),
bfs AS (SELECT 1::BIGINT AS item_id, 0 AS depth UNION SELECT b.dst, depth + 1 FROM bfs JOIN ways b ON b.src = bfs.item_id WHERE depth < 10 AND NOT EXISTS (SELECT 1 FROM bfs z WHERE z.item_id = 2)),
d AS (SELECT item_id, min(depth) AS depth FROM bfs GROUP BY 1),
p AS (SELECT 1::BIGINT AS item_id, [1::BIGINT] AS path, 0 AS depth UNION ALL SELECT b.dst, list_append(path, b.dst), p.depth + 1 FROM p JOIN ways b ON b.src = p.item_id JOIN d ON d.item_id = b.dst AND d.depth = p.depth + 1 WHERE p.depth < (SELECT depth FROM d WHERE item_id = 2))
SELECT depth AS length, array_to_string(path, '>') AS path FROM p WHERE item_id = 2 ORDER BY p.path LIMIT 1""", "links")
def graph_shortest_path(t: Tables) -> DataFrame:
    return g.shortest_path(t.links, 1, 2, max_depth=10)


@query("graph_simple_paths", """
SELECT 1 AS length, 'c:1>n:'||c_nationkey AS path FROM customer WHERE c_custkey = 1 AND c_nationkey = 7
UNION ALL SELECT 3, 'c:1>n:'||c_nationkey||'>r:'||a.n_regionkey||'>n:7' FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = 7 AND b.n_regionkey = a.n_regionkey WHERE c_custkey = 1 AND c_nationkey <> 7""")
def graph_simple_paths(t: Tables) -> DataFrame:
    return g.simple_paths(t.edges.filter("edge_type = 'LOCATED_IN'"), "c:1", HUB, 3)


@query("graph_simple_paths_all")
def graph_simple_paths_all(t: Tables) -> DataFrame:
    """As graph_simple_paths, over every edge and to the reference's cutoff of five hops."""
    return g.simple_paths(t.edges, "c:1", HUB, 5)


@query("graph_betweenness")
def graph_betweenness(t: Tables) -> DataFrame:
    return g.betweenness(t.edges, t.nodes)


_ROUND = """l{1} AS (SELECT l.item_id, coalesce(b.c, l.c) AS c FROM l{0} l LEFT JOIN (SELECT dst, arg_min(c, (-n, c)) AS c FROM (SELECT dst, x.c, count(*) AS n FROM ways JOIN l{0} x ON x.item_id = src GROUP BY 1, 2) GROUP BY 1) b ON b.dst = l.item_id)"""


@query("graph_communities", f"""
WITH ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT item_id, item_id AS c FROM nodes), {_ROUND.format(0, 1)}, {_ROUND.format(1, 2)}, {_ROUND.format(2, 3)}
SELECT item_id, c AS community FROM l3""", "nodes edges")
def graph_communities(t: Tables) -> DataFrame:
    return g.label_communities(t.nodes, t.edges, 3)


@query("graph_random_walk")
def graph_random_walk(t: Tables) -> DataFrame:
    return g.random_walk(t.edges, t.nodes.filter("memory_type = 'order'"), 3)


@query("graph_tag_link_build", "SELECT DISTINCT a.item_id AS src, b.item_id AS dst, 'SHARED_TAG' AS edge_type FROM tags a JOIN tags b ON a.tag = b.tag AND a.item_id < b.item_id WHERE a.tag IN (SELECT tag FROM tags GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)", "tags")
def graph_tag_link_build(t: Tables) -> DataFrame:
    usual = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 50").select("tag")
    kept = t.tags.join(usual, "tag", "left_semi")
    pairs = kept.withColumnRenamed("item_id", "src").join(kept.withColumnRenamed("item_id", "dst"), "tag").filter("src < dst")
    return pairs.select("src", "dst", F.lit("SHARED_TAG").alias("edge_type")).distinct()


@query("graph_tag_hubs", "SELECT item_id, tag, n FROM (SELECT item_id, tag, count(*) OVER (PARTITION BY tag) AS n FROM tags) WHERE n >= 2", "tags")
def graph_tag_hubs(t: Tables) -> DataFrame:
    """The links by every shared tag, however many items hold it: each item's link to the tag; items of one tag are linked."""
    shared = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return t.tags.join(shared, "tag").select("item_id", "tag", "n")


@query("graph_tag_subgraph", "SELECT src, dst FROM edges WHERE edge_type = 'CONTAINS' AND dst IN (SELECT 'p:'||item_id FROM tags WHERE tag = (SELECT max(tag) FROM tags))", "edges tags")
def graph_tag_subgraph(t: Tables) -> DataFrame:
    tagged = t.tags.join(t.tags.agg(F.max("tag").alias("tag")), "tag", "left_semi").select(F.concat(F.lit("p:"), F.col("item_id").cast("string")).alias("dst"))
    return t.edges.filter("edge_type = 'CONTAINS'").join(tagged, "dst", "left_semi").select("src", "dst")
