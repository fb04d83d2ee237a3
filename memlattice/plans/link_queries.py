"""Queries that join memories: evidence, notes, relations, clusters of labels, proofs and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import scores as sc
from memlattice.functions import text as tx
from memlattice.operators import graph as g
from memlattice.operators import search as s
from memlattice.sources.tables import Tables

from .registry import fixture, query

# ---- evidence -------------------------------------------------------------------------------------------------------
_OPINIONS = "(VALUES (1, 'paris', 'Paris is lovely'), (2, 'box', 'the box'), (3, 'sleep', 'sleeping'), (4, 'nowhere', 'x')) o(opinion_id, subject, content)"


def _opinions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "paris", "Paris is lovely"), (2, "box", "the box"), (3, "sleep", "sleeping"), (4, "nowhere", "x")], "opinion_id int, subject string, content string")


@fixture("join_opinion_evidence", f"""
SELECT opinion_id, claim_id, regexp_matches(lower(c.content), 'not|never|stopped|changed|no longer|unlike') AS contradicts FROM {_OPINIONS} JOIN claims c ON contains(lower(c.content), subject)""", "claims")
def join_opinion_evidence(t: Tables) -> DataFrame:
    """Evidence that names an opinion's subject; signal words make it a contradiction.  The opinions, a few, are broadcast."""
    low = F.lower(t.claims["content"])
    hit = t.claims.join(F.broadcast(_opinions(t).select("opinion_id", "subject")), low.contains(F.col("subject")))
    return hit.select("opinion_id", "claim_id", low.rlike("not|never|stopped|changed|no longer|unlike").alias("contradicts"))


_DECISIONS = [(1, "small widget", "tools", ["x"]), (2, "zzz", "PROMO", []), (3, "", "", ["bolt", "gear"]), (4, "nothing at all", "nowhere", [])]


@query("join_decision_evidence", """
SELECT decision_id, p_partkey, regexp_matches(e, 'cold|not') AS contradicts FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS e FROM part) JOIN (VALUES (1, 'small widget', 'tools', ['x']), (2, 'zzz', 'promo', []), (3, '', '', ['bolt', 'gear']), (4, 'nothing at all', 'nowhere', [])) d(decision_id, content, domain, tags)
ON (content <> '' AND contains(e, content)) OR (domain <> '' AND contains(e, domain)) OR len(list_filter(tags, lambda x: contains(e, x))) > 0""")
def join_decision_evidence(t: Tables) -> DataFrame:
    """Evidence that holds a decision's content, domain or one of its tags; the decisions, a few, are broadcast."""
    few = t.spark.createDataFrame(_DECISIONS, "decision_id int, content string, domain string, tags array<string>")
    e = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    named = lambda c: (F.col(c) != "") & e.contains(F.lower(F.col(c)))
    on = named("content") | named("domain") | F.exists("tags", lambda x: e.contains(F.lower(x)))
    return t.part.join(F.broadcast(few), on).select("decision_id", "p_partkey", e.rlike("cold|not").alias("contradicts"))


@fixture("evolve_opinion_reinforcement", f"""
WITH ev AS (SELECT opinion_id, count(*) FILTER (WHERE NOT x) AS s, count(*) FILTER (WHERE x) AS c FROM (SELECT opinion_id, regexp_matches(lower(c.content), 'not|never|stopped|changed|no longer|unlike') AS x FROM {_OPINIONS} JOIN claims c ON contains(lower(c.content), subject)) GROUP BY 1),
sc AS (SELECT opinion_id, CASE WHEN s IS NULL THEN 0.22 - 0.05 ELSE (1 - (1 - 0.22) * pow(0.9, s)) * pow(0.85, c) END AS confidence FROM {_OPINIONS} LEFT JOIN ev USING (opinion_id))
SELECT opinion_id, round(confidence::DOUBLE, 6) AS confidence, confidence < 0.2 AS archived FROM sc""", "claims")
def evolve_opinion_reinforcement(t: Tables) -> DataFrame:
    """Reinforced, then contradicted, by all evidence; without any, 0.05 less; archived below 0.2."""
    ev = join_opinion_evidence(t).groupBy("opinion_id").agg(F.count_if(~F.col("contradicts")).alias("s"), F.count_if(F.col("contradicts")).alias("c"))
    rows = _opinions(t).join(ev, "opinion_id", "left")
    now = F.when(F.col("s").isNull(), F.lit(0.22) - 0.05).otherwise(sc.contradicted(sc.reinforced(F.lit(0.22), F.col("s")), F.col("c")))
    return rows.select("opinion_id", F.round(now, 6).alias("confidence"), (now < 0.2).alias("archived"))


@query("join_new_opinions", "SELECT DISTINCT event_type AS subject FROM events WHERE event_type NOT IN ('click', 'view')")
def join_new_opinions(t: Tables) -> DataFrame:
    """Subjects that no opinion has yet."""
    known = t.spark.createDataFrame([("click",), ("view",)], "subject string")
    return t.events.select(F.col("event_type").alias("subject")).distinct().join(known, "subject", "left_anti")


# ---- notes ----------------------------------------------------------------------------------------------------------
@query("join_concept_related", "SELECT DISTINCT b.item_id FROM tags a JOIN tags b ON a.tag = b.tag WHERE a.item_id = 1 AND b.item_id <> 1 AND length(a.tag) > 4", "tags")
def join_concept_related(t: Tables) -> DataFrame:
    """Notes that share a concept (here a long tag) with one note, whose few concepts are broadcast by the join's side."""
    mine = t.tags.filter("item_id = 1 and length(tag) > 4").select("tag")
    return t.tags.filter("item_id <> 1").join(mine, "tag", "left_semi").select("item_id").distinct()


@query("join_all_connections", """
SELECT 'forward' AS list, dst AS other FROM links WHERE src = 1 UNION SELECT 'back', src FROM links WHERE dst = 1
UNION SELECT 'tag', b.item_id FROM tags a JOIN tags b ON a.tag = b.tag WHERE a.item_id = 1 AND b.item_id <> 1 UNION SELECT 'concept', b.item_id FROM tags a JOIN tags b ON a.tag = b.tag WHERE a.item_id = 1 AND b.item_id <> 1 AND length(a.tag) > 4""", "links tags")
def join_all_connections(t: Tables) -> DataFrame:
    """Four named lists of what a note is connected with."""
    shared = lambda tags: t.tags.filter("item_id <> 1").join(tags.filter("item_id = 1").select("tag"), "tag", "left_semi").select("item_id")
    parts = {"forward": t.links.filter("src = 1").select("dst"), "back": t.links.filter("dst = 1").select("src"), "tag": shared(t.tags), "concept": shared(t.tags.filter("length(tag) > 4"))}
    rows = [df.toDF("other").select(F.lit(k).alias("list"), "other") for k, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).distinct()


_NOTE = "SELECT item_id, list_sort(list(tag)) AS tags, list_filter(list_sort(list(tag)), lambda x: length(x) > 4) AS concepts FROM tags GROUP BY 1"
_PAIRED = f"WITH n AS ({_NOTE}), p AS (SELECT b.item_id, a.concepts AS ca, b.concepts AS cb, a.tags AS ta, b.tags AS tb FROM n a JOIN n b ON a.item_id = 1 AND b.item_id <> 1)"


def _notes(t: Tables) -> DataFrame:
    return t.tags.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.array_sort(F.collect_set(F.when(F.length("tag") > 4, F.col("tag")))).alias("concepts"))


def _against(t: Tables, note: int) -> DataFrame:
    """Every other note beside one, which is broadcast."""
    one = _notes(t).filter(F.col("item_id") == note).select(F.col("tags").alias("ta"), F.col("concepts").alias("ca")).limit(1)
    return _notes(t).filter(F.col("item_id") != note).join(F.broadcast(one), F.lit(True))


@query("join_missing_strength", f"""{_PAIRED}, s AS (SELECT item_id, len(list_intersect(ca, cb)) AS c, len(list_intersect(ta, tb)) AS t, len(list_distinct(list_concat(ca, cb))) AS u FROM p)
SELECT item_id, round(((2 * c + t) / greatest(u, 1))::DOUBLE, 6) AS strength FROM s WHERE (c > 0 OR t > 0) AND item_id NOT IN (SELECT dst FROM links WHERE src = 1) ORDER BY 2 DESC, 1 LIMIT 10""", "tags links")
def join_missing_strength(t: Tables) -> DataFrame:
    """Notes that share concepts or tags with one and aren't linked from it, by strength."""
    c, tag = F.size(F.array_intersect("ca", "concepts")), F.size(F.array_intersect("ta", "tags"))
    linked = t.links.filter("src = 1").select(F.col("dst").alias("item_id"))
    rows = _against(t, 1).filter((c > 0) | (tag > 0)).join(linked, "item_id", "left_anti")
    return s.top_k(rows.select("item_id", F.round((2 * c + tag) / F.greatest(F.size(F.array_union("ca", "concepts")), F.lit(1)), 6).alias("strength")), 10, "strength")


@query("search_relevance", f"""{_PAIRED} SELECT item_id, round((2 * len(list_intersect(ca, cb)) + len(list_intersect(ta, tb)) + CASE WHEN len(list_intersect(ta, tb)) > 5 THEN len(list_intersect(ta, tb)) / 10 ELSE 0 END)::DOUBLE, 6) AS score FROM p""", "tags")
def search_relevance(t: Tables) -> DataFrame:
    c, tag = F.size(F.array_intersect("ca", "concepts")), F.size(F.array_intersect("ta", "tags"))
    return _against(t, 1).select("item_id", F.round((2 * c + tag + F.when(tag > 5, tag / 10.0).otherwise(0.0)).cast("double"), 6).alias("score"))


@query("search_related_notes", f"""
WITH n AS ({_NOTE}), one AS (SELECT DISTINCT dst AS item_id FROM links WHERE src = 1 UNION SELECT src FROM links WHERE dst = 1), two AS (SELECT DISTINCT l.dst AS item_id FROM links l JOIN one ON l.src = one.item_id WHERE l.dst <> 1),
c AS (SELECT item_id FROM one UNION SELECT item_id FROM two)
SELECT c.item_id, round((2 * len(list_intersect(a.concepts, b.concepts)) + len(list_intersect(a.tags, b.tags)))::DOUBLE, 6) AS score FROM c JOIN n b ON b.item_id = c.item_id JOIN n a ON a.item_id = 1 WHERE c.item_id <> 1 ORDER BY 2 DESC, 1 LIMIT 5""", "tags links")
def search_related_notes(t: Tables) -> DataFrame:
    """First and second degree links of a note, scored; the five best."""
    one = t.links.filter("src = 1").select(F.col("dst").alias("item_id")).union(t.links.filter("dst = 1").select("src")).distinct()
    two = t.links.join(one, t.links["src"] == one["item_id"], "left_semi").filter("dst <> 1").select(F.col("dst").alias("item_id"))
    near = one.union(two).distinct()
    c, tag = F.size(F.array_intersect("ca", "concepts")), F.size(F.array_intersect("ta", "tags"))
    rows = _against(t, 1).join(near, "item_id", "left_semi")
    return s.top_k(rows.select("item_id", F.round((2 * c + tag).cast("double"), 6).alias("score")), 5)


@query("join_duplicate_notes", r"""
WITH n AS (SELECT p_partkey, p_name, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), keep AS (SELECT w, arg_min(p_partkey, (-length(p_name), p_partkey)) AS kept FROM n GROUP BY 1)
SELECT p_partkey, CASE WHEN length(p_name) < 9 THEN 'short' ELSE 'duplicate' END AS reason FROM n JOIN keep USING (w) WHERE length(p_name) < 9 OR p_partkey <> kept""")
def join_duplicate_notes(t: Tables) -> DataFrame:
    """Short notes, and those whose words another, longer one has: of so few words a Jaccard of 0.9 is equality, so word sets are
    grouped, not paired; ties keep the earlier."""
    n = t.part.select("p_partkey", "p_name", F.array_sort(tx.tokens(F.col("p_name"))).alias("w"))
    keep = n.groupBy("w").agg(F.min_by("p_partkey", F.struct(-F.length("p_name"), F.col("p_partkey"))).alias("kept"))
    short = F.length("p_name") < 9
    return n.join(keep, "w").filter(short | (F.col("p_partkey") != F.col("kept"))).select("p_partkey", F.when(short, "short").otherwise("duplicate").alias("reason"))


@query("evolve_zettel_prune", r"""
WITH n AS (SELECT p_partkey, p_name, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), keep AS (SELECT w, arg_min(p_partkey, (-length(p_name), p_partkey)) AS kept FROM n GROUP BY 1)
SELECT p_partkey, concat_ws('; ', CASE WHEN length(p_name) < 9 THEN 'short' END, CASE WHEN p_partkey <> kept THEN 'duplicate of ' || kept END) AS reason FROM n JOIN keep USING (w) WHERE length(p_name) < 9 OR p_partkey <> kept""")
def evolve_zettel_prune(t: Tables) -> DataFrame:
    """What would be pruned and why."""
    n = t.part.select("p_partkey", "p_name", F.array_sort(tx.tokens(F.col("p_name"))).alias("w"))
    keep = n.groupBy("w").agg(F.min_by("p_partkey", F.struct(-F.length("p_name"), F.col("p_partkey"))).alias("kept"))
    short, copy = F.length("p_name") < 9, F.col("p_partkey") != F.col("kept")
    reason = F.concat_ws("; ", F.when(short, "short"), F.when(copy, F.concat(F.lit("duplicate of "), F.col("kept").cast("string"))))
    return n.join(keep, "w").filter(short | copy).select("p_partkey", reason.alias("reason"))


# ---- relations and facts --------------------------------------------------------------------------------------------
@query("join_id_remap", "SELECT md5(lower(r_name)) AS extracted, r_regionkey AS stored FROM region")
def join_id_remap(t: Tables) -> DataFrame:
    """An extractor's ids to stored ones by the names' lower case."""
    found = t.region.select(F.lower(F.upper("r_name")).alias("name"), F.md5(F.lower("r_name").cast("binary")).alias("extracted"))
    stored = t.region.select(F.lower("r_name").alias("name"), F.col("r_regionkey").alias("stored"))
    return found.join(stored, "name").select("extracted", "stored")


@query("join_relation_remap", "SELECT n_nationkey AS src, CASE WHEN n_regionkey < 3 THEN n_regionkey + 100 ELSE n_regionkey END AS dst FROM nation WHERE n_nationkey < 20 AND n_regionkey < 4")
def join_relation_remap(t: Tables) -> DataFrame:
    """Relations with both ends remapped where they are known, kept where both are stored or new."""
    mapping = t.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("dst"), (F.col("r_regionkey") + 100).alias("stored"))
    known = mapping.select(F.col("stored").alias("id")).union(t.region.filter("r_regionkey = 3").select("r_regionkey")).union(t.nation.filter("n_nationkey < 20").select("n_nationkey")).distinct()
    rows = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")).join(mapping, "dst", "left").select("src", F.coalesce("stored", "dst").alias("dst"))
    # ids of sources and targets are of separate ranges here
    targets = known.filter("id >= 100 or id = 3")
    return rows.join(t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("src")), "src", "left_semi").join(targets, F.col("dst") == F.col("id"), "left_semi")


@query("join_entity_facts", "SELECT edge_type AS relation, dst AS target FROM edges WHERE src = 'o:1'", "edges")
def join_entity_facts(t: Tables) -> DataFrame:
    return t.edges.filter("src = 'o:1'").select(F.col("edge_type").alias("relation"), F.col("dst").alias("target"))


@query("graph_episode_facts", "SELECT e.edge_type, n.name FROM edges e JOIN nodes n ON n.item_id = e.dst WHERE e.src = (SELECT item_id FROM nodes WHERE memory_type = 'order' AND name = '1-URGENT' ORDER BY item_id LIMIT 1)", "nodes edges")
def graph_episode_facts(t: Tables) -> DataFrame:
    """What leaves a node that is found by its name."""
    one = t.nodes.filter("memory_type = 'order' and name = '1-URGENT'").agg(F.min("item_id").alias("src"))
    return t.edges.join(one, "src", "left_semi").join(t.nodes.select(F.col("item_id").alias("dst"), "name"), "dst").select("edge_type", "name")


_MENTIONED = [("Brand#5", "MENTIONS"), ("Brand#13", None), ("Brand#99", None)]


@query("join_link_new_item", """
WITH e AS (SELECT * FROM (VALUES ('Brand#5', 'MENTIONS'), ('Brand#13', NULL), ('Brand#99', NULL)) v(name, kind)), k AS (SELECT DISTINCT p_brand FROM part)
SELECT 'new' AS src, 'entity:' || lower(name) AS dst, coalesce(kind, 'RELATED') AS edge_type, p_brand IS NOT NULL AS known FROM e LEFT JOIN k ON p_brand = name UNION ALL SELECT 'entity:' || lower(name), 'new', 'MENTIONED_IN', p_brand IS NOT NULL FROM e LEFT JOIN k ON p_brand = name""")
def join_link_new_item(t: Tables) -> DataFrame:
    """Edges of a new item and its entities, RELATED unless typed, in both directions; whether the entity was known."""
    known = t.part.select(F.col("p_brand").alias("name")).distinct().withColumn("known", F.lit(True))
    e = t.spark.createDataFrame(_MENTIONED, "name string, kind string").join(known, "name", "left")
    e = e.select(F.concat(F.lit("entity:"), F.lower("name")).alias("entity"), "kind", F.coalesce("known", F.lit(False)).alias("known"))
    out = e.select(F.lit("new").alias("src"), F.col("entity").alias("dst"), F.coalesce("kind", F.lit("RELATED")).alias("edge_type"), "known")
    return out.union(e.select("entity", F.lit("new"), F.lit("MENTIONED_IN"), "known"))


@query("join_procedure_steps", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'inline' ELSE steps END AS steps FROM orders JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '>' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def join_procedure_steps(t: Tables) -> DataFrame:
    """Steps that a procedure holds itself, else those its HAS_STEP edges lead to, in order."""
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ">").alias("made"))
    own = F.when(F.col("o_orderstatus") == "O", "inline")
    return t.orders.join(made, "o_orderkey").select("o_orderkey", F.coalesce(own, "made").alias("steps"))


@fixture("join_class_ids", "SELECT * FROM (VALUES ('Person', 'Q5'), ('LOCATION', 'Q515'), ('LOCATION', 'Q6256'), ('org', 'Q43229')) v(entity_type, qid)")
def join_class_ids(t: Tables) -> DataFrame:
    """Classes of public knowledge of each type, whatever its case."""
    classes = t.spark.createDataFrame([("person", "Q5"), ("location", "Q515"), ("location", "Q6256"), ("org", "Q43229"), ("event", "Q1656682")], "type string, qid string")
    asked = t.spark.createDataFrame([("Person",), ("LOCATION",), ("org",), ("blob",)], "entity_type string")
    return asked.join(F.broadcast(classes), F.lower("entity_type") == F.col("type")).select("entity_type", "qid")


@query("join_notes_mentioning", "SELECT src AS note FROM edges WHERE edge_type = 'CONTAINS' AND dst = 'p:1'", "edges")
def join_notes_mentioning(t: Tables) -> DataFrame:
    return t.edges.filter("edge_type = 'CONTAINS' and dst = 'p:1'").select(F.col("src").alias("note"))


@query("join_hydrated_hits", """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q))), 6) AS score FROM embeddings, q),
hits AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 30)
SELECT vec_id, p_name AS name, score FROM hits JOIN part ON p_partkey = vec_id WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 10""")
def join_hydrated_hits(t: Tables) -> DataFrame:
    """Three times as many hits as asked for, filtered by kind and joined to their nodes' fields, then cut."""
    q = t.embeddings.filter("vec_id = 1").select(F.col("embedding").alias("q"))
    hits = s.vector_top_k(t.embeddings, q, 30).join(t.embeddings.select("vec_id", "label"), "vec_id").filter("label % 2 = 0")
    rows = hits.join(t.part.select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("name")), "vec_id").select("vec_id", "name", "score")
    return s.top_k(rows, 10, key="vec_id")


@query("join_stale_refs", """
WITH code AS (SELECT p_brand AS path, max(p_size) % 3 AS head FROM part GROUP BY 1)
SELECT p_partkey, r.path FROM (SELECT p_partkey, unnest([{'path': p_brand, 'head': p_size % 3}, {'path': p_type, 'head': 0}]) AS r FROM part) JOIN code ON code.path = r.path WHERE code.head <> r.head""")
def join_stale_refs(t: Tables) -> DataFrame:
    """References of a memory, exploded, whose commit is no longer that of the code."""
    code = t.part.groupBy(F.col("p_brand").alias("path")).agg((F.max("p_size") % 3).alias("now"))
    refs = F.array(F.struct(F.col("p_brand").alias("path"), (F.col("p_size") % 3).alias("head")), F.struct(F.col("p_type").alias("path"), F.lit(0).alias("head")))
    return t.part.select("p_partkey", F.explode(refs).alias("r")).select("p_partkey", "r.path", "r.head").join(code, "path").filter("now <> head").select("p_partkey", "path")


@query("join_concurrent", """
WITH v AS (SELECT item_id, tx_start, tx_end FROM versions WHERE item_id IN (1, 2, 3)), starts AS (SELECT DISTINCT tx_start AS t FROM v)
SELECT t FROM starts WHERE (SELECT count(DISTINCT item_id) FROM v WHERE tx_start <= t AND (tx_end IS NULL OR t < tx_end)) = 3""", "versions")
def join_concurrent(t: Tables) -> DataFrame:
    """Starts of validity at which every one of some items is valid: a running count of items, by their merged intervals."""
    v = t.versions.filter("item_id in (1, 2, 3)").select("item_id", "tx_start", "tx_end")
    ends = v.select("item_id", F.col("tx_start").alias("t"), F.lit(1).alias("d")).union(v.filter("tx_end is not null").select("item_id", "tx_end", F.lit(-1)))
    steps = ends.groupBy("item_id", "t").agg(F.sum("d").alias("d"), F.max(F.col("d") == 1).alias("starts"))
    open_ = steps.withColumn("n", F.sum("d").over(W.partitionBy("item_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("n").over(W.partitionBy("item_id").orderBy("t")), F.lit(0))
    turns = open_.withColumn("turn", (F.col("n") > 0).cast("int") - (before > 0).cast("int"))
    whole = turns.groupBy("t").agg(F.sum("turn").alias("turn"), F.max("starts").alias("starts"))
    running = whole.withColumn("n", F.sum("turn").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    return running.filter("n = 3 and starts").select("t")


@fixture("join_repetition_rate", """
WITH e AS (SELECT ask_id, query, list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> '')) AS w, ask_id * 20 AS minute FROM (SELECT ask_id, query FROM asked UNION ALL SELECT ask_id + 100, query || ' please' FROM asked WHERE ask_id < 6 UNION ALL SELECT ask_id + 200, query FROM asked))
SELECT round((count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e p WHERE p.minute <= e.minute - 30 AND len(p.w) > 0 AND len(e.w) > 0 AND len(list_intersect(p.w, e.w)) / len(list_distinct(list_concat(p.w, e.w))) >= 0.85)) / count(*))::DOUBLE, 6) AS rate FROM e""", "asked")
def join_repetition_rate(t: Tables) -> DataFrame:
    """Share of queries with an earlier, similar one (Jaccard 0.85) at least 30 minutes before: candidates share one of their
    rarer words, as sets so alike must, and each query counts once."""
    asked = t.asked.select("ask_id", "query").union(t.asked.filter("ask_id < 6").select(F.col("ask_id") + 100, F.concat("query", F.lit(" please")))).union(t.asked.select(F.col("ask_id") + 200, "query"))
    e = asked.select("ask_id", tx.tokens(F.col("query")).alias("w"), (F.col("ask_id") * 20).alias("minute"))
    words = e.select("ask_id", "w", "minute", F.explode("w").alias("word"))
    times = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # sets of n words with a Jaccard of 0.85 differ in fewer than 0.15 n of them, so they share one of that many and one more rarest
    nth = F.row_number().over(W.partitionBy("ask_id").orderBy("df", "word"))
    prefix = words.join(times, "word").withColumn("nth", nth).filter(F.col("nth") <= F.floor(F.size("w") * 0.15) + 1).select("word", "ask_id", "w", "minute")
    p = prefix.select("word", F.col("w").alias("pw"), F.col("minute").alias("pm"))
    again = prefix.join(p, "word").filter((F.col("pm") <= F.col("minute") - 30) & (tx.jaccard(F.col("w"), F.col("pw")) >= 0.85)).select("ask_id").distinct().withColumn("hit", F.lit(1.0))
    return e.join(again, "ask_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("rate"))


# ---- proofs and paths -----------------------------------------------------------------------------------------------
@query("graph_proof_tree", """
WITH RECURSIVE p AS (SELECT 'o:1' AS item_id, 'o:1' AS path, 0 AS depth UNION ALL SELECT e.dst, p.path || '>' || e.dst, p.depth + 1 FROM p JOIN edges e ON e.src = p.item_id AND e.edge_type IN ('PLACED_BY', 'CONTAINS', 'LOCATED_IN') WHERE p.depth < 5 AND NOT contains('>' || p.path || '>', '>' || e.dst || '>'))
SELECT path, depth FROM p""", "edges")
def graph_proof_tree(t: Tables) -> DataFrame:
    """Paths of provenance from a decision, five deep at most, no node twice in one."""
    return g.paths_from(t.edges.filter(F.col("edge_type").isin("PLACED_BY", "CONTAINS", "LOCATED_IN")), "o:1", 5)


@query("graph_effects", """
WITH RECURSIVE r AS (SELECT 'r:1' AS item_id, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.item_id AND e.edge_type IN ('PLACED_BY', 'LOCATED_IN') WHERE depth < 3)
SELECT item_id, min(depth) AS depth FROM r GROUP BY 1""", "edges")
def graph_effects(t: Tables) -> DataFrame:
    """What a node leads to, three steps along reversed edges of given kinds."""
    back = t.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    return g.reach(back, "r:1", 3, ["PLACED_BY", "LOCATED_IN"])


@query("graph_related_procedures", """
WITH RECURSIVE r AS (SELECT 1::BIGINT AS item_id, 0 AS depth UNION SELECT l.dst, depth + 1 FROM r JOIN links l ON l.src = r.item_id AND l.edge_type = 'click' WHERE depth < 2) SELECT item_id, min(depth) AS depth FROM r WHERE item_id <> 1 GROUP BY 1""", "links")
def graph_related_procedures(t: Tables) -> DataFrame:
    return g.reach(t.links, 1, 2, ["click"]).filter("item_id <> 1")


_SMALL = "(VALUES ('a','b'), ('b','c'), ('c','d'), ('d','e'), ('b','e'), ('f','g'), ('e','h')) e(src, dst)"


def _small(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(*e, "L") for e in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "e"), ("f", "g"), ("e", "h"))], "src string, dst string, edge_type string")


_BETWEEN = f"""
WITH RECURSIVE e AS (SELECT * FROM {_SMALL}), d AS (SELECT src AS s, dst AS t, 1 AS k, [src, dst] AS path FROM e UNION ALL SELECT d.s, e.dst, d.k + 1, list_append(d.path, e.dst) FROM d JOIN e ON e.src = d.t WHERE NOT list_contains(d.path, e.dst)),
short AS (SELECT * FROM d WHERE (s, t, k) IN (SELECT s, t, min(k) FROM d GROUP BY 1, 2)), n AS (SELECT s, t, count(*) AS n FROM short GROUP BY 1, 2),
mid AS (SELECT unnest(path[2:len(path) - 1]) AS v, 1.0 / n AS part FROM short JOIN n USING (s, t)), v AS (SELECT src AS item_id FROM e UNION SELECT dst FROM e)
SELECT item_id, round((coalesce(sum(part), 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2))::DOUBLE, 6) AS score FROM v LEFT JOIN mid ON mid.v = item_id GROUP BY 1"""


def _between(t: Tables) -> DataFrame:
    e = _small(t)
    nodes = e.select(F.col("src").alias("item_id")).union(e.select("dst")).distinct()
    return g.betweenness(e, nodes).select("item_id", F.round("betweenness", 6).alias("score"))


@fixture("graph_betweenness_small", _BETWEEN)
def graph_betweenness_small(t: Tables) -> DataFrame:
    """The same operator as graph_betweenness on a graph that SQL can search whole."""
    return _between(t)


@fixture("graph_bridges", f"SELECT item_id, score FROM ({_BETWEEN}) WHERE score > 0.05")
def graph_bridges(t: Tables) -> DataFrame:
    return _between(t).filter("score > 0.05")


@fixture("graph_knowledge_paths", f"""
WITH RECURSIVE u AS (SELECT src, dst, 0.5 AS w FROM {_SMALL} UNION SELECT dst, src, 0.5 FROM {_SMALL}), p AS (SELECT 'a' AS here, ['a'] AS path UNION ALL SELECT u.dst, list_append(p.path, u.dst) FROM p JOIN u ON u.src = p.here WHERE len(p.path) <= 4 AND NOT list_contains(p.path, u.dst) AND p.here <> 'e')
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS length, CASE WHEN len(path) <= 3 THEN 'direct' WHEN len(path) <= 5 THEN 'indirect' ELSE 'serendipitous' END AS kind FROM p WHERE here = 'e'""")
def graph_knowledge_paths(t: Tables) -> DataFrame:
    """Simple paths between two notes, by kind of length."""
    p = g.simple_paths(_small(t), "a", "e", 4)
    return p.select("path", "length", F.when(F.col("length") <= 2, "direct").when(F.col("length") <= 4, "indirect").otherwise("serendipitous").alias("kind"))


@fixture("graph_components_small", f"""
WITH RECURSIVE u AS (SELECT src, dst FROM {_SMALL} UNION SELECT dst, src FROM {_SMALL}), r AS (SELECT src AS item_id, src AS seen FROM u UNION SELECT r.item_id, u.dst FROM r JOIN u ON u.src = r.seen) SELECT item_id, min(seen) AS component FROM r GROUP BY 1 UNION ALL SELECT 'z', 'z'""")
def graph_components_small(t: Tables) -> DataFrame:
    e = _small(t)
    nodes = e.select(F.col("src").alias("item_id")).union(e.select("dst")).union(t.spark.createDataFrame([("z",)], "item_id string")).distinct()
    return g.connected_components(nodes, e)


@fixture("graph_closure_chain", "SELECT i AS src, j AS dst FROM range(1, 81) a(i), range(1, 82) b(j) WHERE j > i + 1")
def graph_closure_chain(t: Tables) -> DataFrame:
    """The closure of a chain of 80 edges."""
    e = t.spark.range(1, 81).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("L").alias("edge_type"))
    return g.transitive_closure(e, "L")


@fixture("graph_long_path", "SELECT 15::INTEGER AS length, '1>2>3>4>5>6>7>8>9>10>11>12>13>14>15>16' AS path")
def graph_long_path(t: Tables) -> DataFrame:
    e = t.spark.range(1, 40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("L").alias("edge_type"))
    return g.shortest_path(e, 1, 16, max_depth=None)


@fixture("graph_orphans_small", "SELECT 'z' AS item_id")
def graph_orphans_small(t: Tables) -> DataFrame:
    e = _small(t)
    nodes = e.select(F.col("src").alias("item_id")).union(t.spark.createDataFrame([("z",)], "item_id string")).distinct()
    return g.orphans(nodes, e).select("item_id")


@fixture("score_path_relevance", f"""
WITH RECURSIVE u AS (SELECT src, dst FROM {_SMALL} UNION SELECT dst, src FROM {_SMALL}), r AS (SELECT 'a' AS at, 0 AS k UNION SELECT u.dst, k + 1 FROM r JOIN u ON u.src = r.at WHERE k < 8)
SELECT v AS item_id, round(coalesce(1.0 / (min(k) + 1), 0)::DOUBLE, 6) AS score FROM (VALUES ('a'), ('d'), ('h'), ('g')) t(v) LEFT JOIN r ON r.at = v GROUP BY 1""")
def score_path_relevance(t: Tables) -> DataFrame:
    """1 over the nodes of the shortest path from a key to its targets, 0 if there is none."""
    targets = t.spark.createDataFrame([("a",), ("d",), ("h",), ("g",)], "item_id string")
    far = g.reach(_small(t), "a", 8, directed=False)
    return targets.join(far, "item_id", "left").select("item_id", F.round(F.coalesce(1 / (F.col("depth") + 1), F.lit(0.0)), 6).alias("score"))


@query("graph_load", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE src IN (SELECT item_id FROM nodes) AND dst IN (SELECT item_id FROM nodes)) AS usable", "nodes edges")
def graph_load(t: Tables) -> DataFrame:
    """The graph mirrored for repeated algorithms: a saved table of its edges and counts of both."""
    mirror = g.Rounds(t.spark).save(t.edges)
    whole = g.insert_edges(mirror, t.nodes)
    return g.counts(t.nodes, mirror).join(whole.agg(F.count(F.lit(1)).alias("usable")), F.lit(True)).select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"), "usable")


