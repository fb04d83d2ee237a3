"""Queries of beliefs, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import scores as sc
from memlattice.operators import analytics as an
from memlattice.operators import dedup as dd
from memlattice.operators import graph as g
from memlattice.operators import relations as rl
from memlattice.operators import simjoin as sj
from memlattice.sources.tables import Tables, days_before, spread

from .registry import query

NOW = "TIMESTAMP '2024-01-31'"
AGE = f"(epoch({NOW}) - epoch(ts)) / 86400.0::DOUBLE"


def age() -> Column:
    return days_before(F.col("ts"))


@query("belief_retention", f"SELECT event_id, round(exp(-({AGE}) / 30.0::DOUBLE), 6) AS retention, exp(-({AGE}) / 30.0::DOUBLE) < 0.5 AS archived FROM events")
def belief_retention(t: Tables) -> DataFrame:
    r = sc.retention(age())
    return t.events.select("event_id", F.round(r, 6).alias("retention"), (r < 0.5).alias("archived"))


@query("belief_decision_confidence", """
SELECT decision_id, round(CASE WHEN supporting + contradicting > 0 THEN (1 - (1 - confidence) * pow(0.9::DOUBLE, supporting)) * pow(0.85::DOUBLE, contradicting) ELSE greatest(0, confidence - 0.05) END, 6) AS confidence FROM decisions""", "decisions")
def belief_decision_confidence(t: Tables) -> DataFrame:
    c = sc.decision_confidence(F.col("confidence"), F.col("supporting"), F.col("contradicting"), days_before(F.col("created_at")))
    return t.decisions.select("decision_id", F.round(c, 6).alias("confidence"))


@query("belief_decision_reinforce", "SELECT decision_id, round(1 - (1 - confidence) * pow(0.9::DOUBLE, supporting) + 1e-10::DOUBLE, 6) AS confidence FROM decisions", "decisions")
def belief_decision_reinforce(t: Tables) -> DataFrame:
    return t.decisions.select("decision_id", F.round(sc.reinforced(F.col("confidence"), F.col("supporting")) + 1e-10, 6).alias("confidence"))


@query("belief_decision_contradict", "SELECT decision_id, round(confidence * pow(0.85::DOUBLE, contradicting), 6) AS confidence FROM decisions", "decisions")
def belief_decision_contradict(t: Tables) -> DataFrame:
    return t.decisions.select("decision_id", F.round(sc.contradicted(F.col("confidence"), F.col("contradicting")), 6).alias("confidence"))


@query("belief_stability", "SELECT decision_id, round(CASE WHEN supporting + contradicting > 0 THEN supporting / (supporting + contradicting) ELSE 0.5 END, 6) AS stability FROM decisions", "decisions")
def belief_stability(t: Tables) -> DataFrame:
    return t.decisions.select("decision_id", F.round(sc.stability(F.col("supporting"), F.col("contradicting")), 6).alias("stability"))


@query("belief_temporal_proximity", """
SELECT user_id, event_id, round(CASE WHEN s < 60 THEN 0.95 WHEN s < 3600 THEN 0.8 * exp(-s / 1800) WHEN s < 86400 THEN 0.6 * exp(-(s - 3600) / 7200) WHEN s < 604800 THEN 0.3 * exp(-(s - 86400) / 172800) ELSE 0.1 * exp(-(s - 604800) / 1209600) END, 6) AS score
FROM (SELECT user_id, event_id, epoch(ts)::DOUBLE - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS s FROM events) WHERE s IS NOT NULL""")
def belief_temporal_proximity(t: Tables) -> DataFrame:

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = (micros - F.lag(micros).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    return t.events.withColumn("s", s).filter("s is not null").select("user_id", "event_id", F.round(sc.temporal_proximity(F.col("s")), 6).alias("score"))


@query("belief_retrieval_strengthening", f"""
WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n, count(*) FILTER (WHERE {AGE} <= 7) AS week, count(*) AS month FROM events GROUP BY 1)
SELECT user_id, round(greatest(0, least(1, CASE WHEN n > 0 THEN 0.5 + 0.1 * ln(1 + n) / 2 * week / (month + 1e-6::DOUBLE) ELSE 0.5 * 0.85 END)), 6) AS strength FROM r""")
def belief_retrieval_strengthening(t: Tables) -> DataFrame:
    r = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.count_if(age() <= 7).alias("week"), F.count(F.lit(1)).alias("month"))
    return r.select("user_id", F.round(sc.strengthened(F.lit(0.5), F.col("n"), F.lit(1), F.col("week"), F.col("month")), 6).alias("strength"))


@query("belief_hebbian", """
WITH p AS (SELECT src, dst, count(*) AS n FROM (SELECT least(a.user_id, b.user_id) AS src, greatest(a.user_id, b.user_id) AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id) GROUP BY 1, 2 HAVING count(*) >= 3),
top AS (SELECT * FROM p ORDER BY n DESC, src, dst LIMIT 500)
SELECT item_id, round(max(least(0.3, (n - 3) * 0.02))::DOUBLE, 6) AS boost FROM (SELECT src AS item_id, n FROM top UNION ALL SELECT dst, n FROM top) GROUP BY 1""")
def belief_hebbian(t: Tables) -> DataFrame:
    after = t.events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("other"))
    pairs = t.events.join(after, "event_id").filter("user_id <> other").select(F.least("user_id", "other").alias("src"), F.greatest("user_id", "other").alias("dst"))
    top = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").orderBy(F.desc("n"), "src", "dst").limit(500)
    ends = top.select(F.explode(F.array("src", "dst")).alias("item_id"), "n")
    return ends.groupBy("item_id").agg(F.round(F.max(sc.hebbian_boost(F.col("n"))), 6).alias("boost"))


@query("belief_active_decisions", "SELECT decision_id FROM decisions WHERE status = 'active' AND domain = '1-URGENT' AND confidence >= 0.5", "decisions")
def belief_active_decisions(t: Tables) -> DataFrame:
    return t.decisions.filter("status = 'active' and domain = '1-URGENT' and confidence >= 0.5").select("decision_id")


@query("belief_pending_decisions", "SELECT decision_id FROM decisions WHERE status = 'pending'", "decisions")
def belief_pending_decisions(t: Tables) -> DataFrame:
    return t.decisions.filter("status = 'pending'").select("decision_id")


@query("belief_low_confidence", "SELECT decision_id, round(confidence, 6) AS confidence FROM decisions WHERE coalesce(confidence, 1) < 0.3 ORDER BY confidence, decision_id LIMIT 50", "decisions")
def belief_low_confidence(t: Tables) -> DataFrame:
    """By the confidence as it is shown: those that round to the same one come by their ids."""
    low = t.decisions.filter(F.coalesce("confidence", F.lit(1.0)) < 0.3).select("decision_id", F.round("confidence", 6).alias("confidence"))
    return low.orderBy("confidence", "decision_id").limit(50)


@query("belief_decision_conflicts", "SELECT a.decision_id AS a, b.decision_id AS b FROM decisions a JOIN decisions b ON a.owner = b.owner AND a.domain = b.domain AND a.decision_id < b.decision_id WHERE a.status = 'active' AND b.status = 'active'", "decisions")
def belief_decision_conflicts(t: Tables) -> DataFrame:
    a = t.decisions.filter("status = 'active'").select("owner", "domain", F.col("decision_id").alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), ["owner", "domain"]).filter("a < b").select("a", "b")


_OVERLAPS = """
WITH w AS (SELECT decision_id, owner, domain, list_distinct(list(word)) AS s FROM (SELECT decision_id, owner, domain, unnest(string_split(lower(domain || ' ' || p_name), ' ')) AS word
  FROM decisions JOIN lineitem ON l_orderkey = decision_id JOIN part ON p_partkey = l_partkey WHERE status = 'active') GROUP BY 1, 2, 3)
SELECT a.owner, a.decision_id AS a, b.decision_id AS b, a.domain = b.domain AS same_domain, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 6) AS overlap
FROM w a JOIN w b ON a.owner = b.owner AND a.decision_id < b.decision_id WHERE 2 * len(list_intersect(a.s, b.s)) > least(len(a.s), len(b.s))"""


@query("belief_decision_overlaps", _OVERLAPS, "decisions")
def belief_decision_overlaps(t: Tables) -> DataFrame:
    """Active decisions of one owner whose words (domain and names of the parts) overlap by more than half of the fewer ones."""
    named = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    live = t.decisions.filter("status = 'active'").select("decision_id", "owner", "domain")
    told = live.join(named, F.col("decision_id") == F.col("l_orderkey")).select("decision_id", "owner", "domain", F.explode(sj.words(F.concat_ws(" ", "domain", "p_name"))).alias("word"))
    sets = told.groupBy("decision_id", "owner").agg(F.collect_set("word").alias("words"))
    domain = lambda k: live.select(F.col("decision_id").alias(k), F.col("domain").alias(f"{k}_domain"))
    pairs = sj.overlap_pairs(sets, "decision_id", "words", 0.5, ["owner"]).join(domain("a"), "a").join(domain("b"), "b")
    return pairs.select("owner", "a", "b", (F.col("a_domain") == F.col("b_domain")).alias("same_domain"), F.round("overlap", 6).alias("overlap"))


@query("belief_observation_synthesis", """
SELECT c_custkey AS entity, CASE WHEN count(*) >= 2 THEN 'Summary of ' || c_custkey || ': ' || array_to_string(list_slice(list(o_orderpriority ORDER BY o_orderdate, o_orderkey), 1, 5), '; ') END AS observation, count(*) AS facts
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 2""")
def belief_observation_synthesis(t: Tables) -> DataFrame:
    # pre-aggregated lists of a customer's orders; only five facts are kept of each
    facts = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("facts"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("f")).filter("facts >= 2")
    first = F.array_join(F.transform(F.slice("f", 1, 5), lambda x: x["o_orderpriority"]), "; ")
    return facts.select("entity", F.concat(F.lit("Summary of "), F.col("entity").cast("string"), F.lit(": "), first).alias("observation"), "facts")


@query("belief_episodic_decay", f"SELECT event_id FROM events WHERE {AGE} > 20")
def belief_episodic_decay(t: Tables) -> DataFrame:
    return t.events.filter(age() > 20).select("event_id")


@query("belief_episodic_to_semantic", f"SELECT event_id, 'semantic' AS memory_type FROM events WHERE value >= 90 AND {AGE} >= 3")
def belief_episodic_to_semantic(t: Tables) -> DataFrame:
    return t.events.filter((F.col("value") >= 90) & (age() >= 3)).select("event_id", F.lit("semantic").alias("memory_type"))


@query("belief_working_to_episodic", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 40")
def belief_working_to_episodic(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 40")


@query("belief_opinion_patterns", "SELECT user_id, event_type, count(*) AS n, round(least(1, count(*) / 10.0::DOUBLE), 6) AS strength FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def belief_opinion_patterns(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.events.groupBy("user_id", "event_type").agg(n.alias("n"), F.round(F.least(F.lit(1.0), n / 10.0), 6).alias("strength")).filter("n >= 3")


@query("belief_candidate_frequency", "SELECT user_id, round(least(1, 0.4 * n / t + 0.6 * ln(1 + n) / ln(1 + t)), 6) AS score FROM (SELECT user_id, count(*)::DOUBLE AS n, (SELECT count(*) FROM events)::DOUBLE AS t FROM events GROUP BY 1)")
def belief_candidate_frequency(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = t.events.agg(F.count(F.lit(1)).cast("double").alias("t"))
    return n.join(F.broadcast(total), F.lit(True)).select("user_id", F.round(sc.candidate_frequency(F.col("n"), F.col("t")), 6).alias("score"))


# ---- aggregates ---------------------------------------------------------------------------------------------------

WORD_ROWS = r"SELECT {0}, unnest(list_filter(regexp_split_to_array(lower({1}), '\s+'), lambda x: x <> '')) AS word FROM {2}"


@query("agg_top_words", f"WITH n AS (SELECT memory_type, word, count(*) AS n FROM ({WORD_ROWS.format('memory_type', 'content', 'items')}) GROUP BY 1, 2) SELECT memory_type, word, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 5", "items")
def agg_top_words(t: Tables) -> DataFrame:
    return an.top_words(an.word_counts(t.items, ["memory_type"], "content"), ["memory_type"], 5)


@query("agg_keyword_extraction", f"WITH n AS (SELECT word, count(*) AS n FROM ({WORD_ROWS.format('item_id', 'content', 'items')}) GROUP BY 1) SELECT word, round(n / (SELECT sum(n) FROM n), 6) AS share FROM n WHERE length(word) > 3 ORDER BY n DESC, word LIMIT 100", "items")
def agg_keyword_extraction(t: Tables) -> DataFrame:
    n = an.word_counts(t.items, [], "content")
    total = n.agg(F.sum("n").alias("total"))
    return n.filter(F.length("word") > 3).orderBy(F.desc("n"), "word").limit(100).join(F.broadcast(total), F.lit(True)).select("word", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("agg_concept_drift", """
WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
f AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) + 1e-10::DOUBLE AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) + 1e-10::DOUBLE AS q FROM a FULL JOIN b USING (event_type)),
g AS (SELECT p / (1 + 1e-10::DOUBLE * (SELECT count(*) FROM f)) AS p, q / (1 + 1e-10::DOUBLE * (SELECT count(*) FROM f)) AS q FROM f)
SELECT round((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 6) AS js, round(sum(p * ln(p / q)), 6) AS kl FROM g""")
def agg_concept_drift(t: Tables) -> DataFrame:
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    n = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return an.jensen_shannon(n(t.events.filter(F.col("ts") < half)), n(t.events.filter(F.col("ts") >= half)), "event_type")


@query("agg_gini", "SELECT event_type, round(sum((2 * i - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini FROM (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def agg_gini(t: Tables) -> DataFrame:
    return an.gini(t.events, ["event_type"], "value")


@query("agg_statistical_bias", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source, n, n / (SELECT sum(n) FROM n) AS p FROM n) SELECT source, n, round(p, 6) AS share, round((SELECT sum(-p * ln(p)) FROM p), 6) AS entropy, round((SELECT max(n) / min(n) FROM n), 6) AS max_min_ratio FROM p")
def agg_statistical_bias(t: Tables) -> DataFrame:
    return an.distribution(t.documents, "source")


@query("agg_value_bias", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def agg_value_bias(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"))


@query("agg_skill_patterns", "SELECT tag, count(*) AS n FROM tags GROUP BY 1 HAVING count(*) >= 5", "tags")
def agg_skill_patterns(t: Tables) -> DataFrame:
    return t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("agg_concept_emergence", "SELECT a.tag, round(count(DISTINCT b.tag) * (SELECT count(*) FROM tags z WHERE z.tag = a.tag) / (SELECT count(DISTINCT item_id) FROM tags)::DOUBLE, 6) AS score FROM tags a LEFT JOIN tags b ON a.item_id = b.item_id AND a.tag <> b.tag GROUP BY 1", "tags")
def agg_concept_emergence(t: Tables) -> DataFrame:
    pairs = t.tags.join(t.tags.select("item_id", F.col("tag").alias("other")), "item_id").filter("tag <> other").select("tag", "other").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("k"))
    n = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = t.tags.agg(F.count_distinct("item_id").alias("t"))
    return n.join(pairs, "tag", "left").join(F.broadcast(total), F.lit(True)).select("tag", F.round(F.coalesce("k", F.lit(0)) * F.col("n") / F.col("t"), 6).alias("score"))


@query("agg_token_rollup", "SELECT event_type, user_id % 5 AS model, round(sum(value), 4) AS spent, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def agg_token_rollup(t: Tables) -> DataFrame:
    return t.events.withColumn("model", F.col("user_id") % 5).rollup("event_type", "model").agg(F.round(F.sum("value"), 4).alias("spent"), F.count(F.lit(1)).alias("n"))


@query("agg_evaluation", "SELECT round(avg(quality), 6) AS relevance, round(avg(CASE WHEN quality >= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(toxic), 6) AS redundancy FROM labels")
def agg_evaluation(t: Tables) -> DataFrame:
    return t.labels.agg(F.round(F.avg("quality"), 6).alias("relevance"), F.round(F.avg(F.when(F.col("quality") >= 1, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg("toxic"), 6).alias("redundancy"))


@query("agg_precision_recall", """
WITH f AS (SELECT l_orderkey AS k, min(l_returnflag) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), t AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'N' ELSE 'A' END AS v FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT count(*) FILTER (WHERE f.v = t.v) AS correct, count(*) FILTER (WHERE f.v <> t.v) AS wrong_type, count(*) FILTER (WHERE t.v IS NULL) AS spurious, count(*) FILTER (WHERE f.v IS NULL) AS missing FROM f FULL JOIN t USING (k)),
r AS (SELECT *, correct / (correct + wrong_type + spurious) AS p, correct / (correct + wrong_type + missing) AS r FROM n)
SELECT correct, wrong_type, spurious, missing, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""")
def agg_precision_recall(t: Tables) -> DataFrame:
    found = t.lineitem.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_returnflag").alias("v"))
    truth = t.orders.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "N").otherwise("A").alias("v"))
    return an.precision_recall(found, truth, ["k"], "v")


@query("agg_summarize", "SELECT conv_id, count(*) AS n, array_to_string(list_slice(list(substr(text, 1, 100) ORDER BY turn, text), 1, 3), '|') AS previews FROM conversations GROUP BY 1")
def agg_summarize(t: Tables) -> DataFrame:
    c = F.array_sort(F.collect_list(F.struct("turn", "text")))
    out = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), c.alias("c"))
    return out.select("conv_id", "n", F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.substring(x["text"], 1, 100)), "|").alias("previews"))


@query("agg_buffer_summary", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY 1")
def agg_buffer_summary(t: Tables) -> DataFrame:
    c = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(c, lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query("agg_type_consistency", "SELECT p_brand, p_type, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY 1, 2")
def agg_type_consistency(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    total = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("t"))
    return n.join(total, "p_brand").select("p_brand", "p_type", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("agg_promotion_gates", """
SELECT p_brand, CASE WHEN length(p_brand) < 3 THEN 'length' WHEN p_brand IN ('Brand#1') THEN 'blocklist' WHEN avg(p_retailprice) / 1000 < 0.7 THEN 'confidence' WHEN count(*) < 2 THEN 'frequency' ELSE 'promoted' END AS outcome FROM part GROUP BY 1""")
def agg_promotion_gates(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("c"))
    outcome = F.when(F.length("p_brand") < 3, "length").when(F.col("p_brand").isin("Brand#1"), "blocklist").when(F.col("c") / 1000 < 0.7, "confidence").when(F.col("n") < 2, "frequency").otherwise("promoted")
    return n.select("p_brand", outcome.alias("outcome"))


@query("agg_promotion_consistency", """
WITH k AS (SELECT p_brand, CASE WHEN p_size < 40 THEN 'small' ELSE 'large' END AS kind, count(*) AS n, sum(p_retailprice) AS total FROM part GROUP BY 1, 2),
c AS (SELECT p_brand, sum(n)::BIGINT AS n, sum(total) / sum(n) / 1000 AS confidence, max(n) / sum(n) AS consistency, arg_max(kind, (n, kind)) AS kind FROM k GROUP BY 1)
SELECT p_brand, kind, n, round(consistency, 6) AS consistency, CASE WHEN p_brand = 'Brand#1' THEN 'blocklist' WHEN confidence < 0.7 THEN 'confidence' WHEN n < 2 THEN 'frequency' WHEN consistency < 0.8 THEN 'consistency' ELSE 'promoted' END AS outcome FROM c""")
def agg_promotion_consistency(t: Tables) -> DataFrame:
    """Brands as candidates: the share of their most frequent kind is the last gate."""
    seen = t.part.select(F.col("p_brand").alias("name"), F.when(F.col("p_size") < 40, "small").otherwise("large").alias("kind"), (F.col("p_retailprice") / 1000).alias("confidence"))
    c = rl.candidates(seen)
    gate = rl.promotion_gate(F.col("name"), F.col("confidence"), F.col("n"), F.col("consistency"), ["brand#1"])
    return c.select(F.col("name").alias("p_brand"), "kind", "n", F.round("consistency", 6).alias("consistency"), gate.alias("outcome"))


# ---- set operations -------------------------------------------------------------------------------------------------


@query("set_canonical_key", r"SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') || '|' || lower(trim(p_type)) AS key FROM part")
def set_canonical_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", dd.canonical_key(F.col("p_name"), F.col("p_type")).alias("key"))


@query("set_dedup_entities", r"""
SELECT regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g') || '|' || lower(trim(p_type)) AS key, round(max(p_retailprice), 6) AS confidence, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, count(*) AS n_merged, arg_min(p_brand, (-p_retailprice, p_partkey)) AS p_brand FROM part GROUP BY 1""")
def set_dedup_entities(t: Tables) -> DataFrame:
    rows = t.part.select("p_name", "p_type", "p_brand", F.col("p_retailprice").alias("confidence"), "p_partkey")
    out = dd.dedup_entities(rows, dd.canonical_key(F.col("p_name"), F.col("p_type")), "confidence", "p_partkey")
    return out.select("key", F.round("confidence", 6).alias("confidence"), "p_partkey", "n_merged", "p_brand")


@query("set_content_dedup", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY text")
def set_content_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("h"), F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id")


@query("set_union_neighbours", "SELECT dst AS item_id FROM links WHERE src = 3 UNION SELECT src FROM links WHERE dst = 3", "links")
def set_union_neighbours(t: Tables) -> DataFrame:
    return g.both_ways(t.links).filter("src = 3").select(F.col("dst").alias("item_id")).distinct()


@query("set_relation_dedup", "SELECT lower(src) AS s, lower(edge_type) AS p, lower(dst) AS o, count(*) AS n FROM edges GROUP BY 1, 2, 3", "edges")
def set_relation_dedup(t: Tables) -> DataFrame:
    # hardly any triple repeats, so counts before the shuffle would hold them all
    triples = t.edges.select(F.lower("src").alias("s"), F.lower("edge_type").alias("p"), F.lower("dst").alias("o"))
    return spread(triples, t.edge_rows, "s", "p", "o").groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


@query("set_layer_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'base_only' WHEN a.k IS NULL THEN 'overlay_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'overridden' END AS state FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey + 50 AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k")
def set_layer_diff(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return dd.layer_diff(base, t.supplier.select((F.col("s_suppkey") + 50).alias("k"), F.col("s_nationkey").alias("v")), "k", "v")


@query("set_layered_view", "WITH b AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), o AS (SELECT s_suppkey + 50 AS k, s_nationkey AS v FROM supplier) SELECT * FROM b WHERE k % 11 <> 0 AND k NOT IN (SELECT k FROM o) UNION ALL SELECT * FROM o")
def set_layered_view(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    overlay = t.supplier.select((F.col("s_suppkey") + 50).alias("k"), F.col("s_nationkey").alias("v"))
    return dd.layered(base, overlay, base.filter("k % 11 = 0"), "k")


@query("set_schema_diff", """
WITH a AS (SELECT o_orderkey AS tool, 'p' AS property, o_orderstatus AS type, o_orderkey % 2 = 0 AS required FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS tool, 'p' AS property, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS type, o_orderkey % 4 = 0 AS required FROM orders WHERE o_orderkey % 7 <> 0),
c AS (SELECT tool, property, CASE WHEN a.type IS NULL THEN 'added' WHEN b.type IS NULL THEN 'removed' WHEN a.type <> b.type THEN 'type_changed' WHEN a.required <> b.required THEN CASE WHEN b.required THEN 'required' ELSE 'optional' END END AS change, b.required AS r FROM a FULL JOIN b USING (tool, property))
SELECT tool, property, change, change IN ('removed', 'type_changed', 'required') OR (change = 'added' AND coalesce(r, FALSE)) AS breaking FROM c WHERE change IS NOT NULL""")
def set_schema_diff(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    row = lambda df, kind, req: df.select(k.alias("tool"), F.lit("p").alias("property"), kind.alias("type"), req.alias("required"))
    old = row(t.orders.filter("o_orderkey % 3 <> 0"), F.col("o_orderstatus"), k % 2 == 0)
    return dd.schema_diff(old, row(t.orders.filter("o_orderkey % 7 <> 0"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), k % 4 == 0))


@query("set_relation_clusters", "SELECT regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g') AS label, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(*) >= 5")
def set_relation_clusters(t: Tables) -> DataFrame:
    label = F.regexp_replace(F.lower(F.trim("p_type")), "[^a-z0-9]+", "_").alias("label")
    return t.part.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands")).filter("n >= 5")


@query("set_store_tools_except", "SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def set_store_tools_except(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("k")).distinct().exceptAll(t.part.filter("p_size < 25").select("p_partkey")).distinct()
