"""Queries of routing, challenging, conflicts, confidence and what texts decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlattice.functions import reasoning as rs
from memlattice.functions import text as tx
from memlattice.sources.tables import Tables, days_before

from .registry import fixture, query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_quoted('(?i)' + p)})" for p in patterns) + ")"


def _holds(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_quoted(p)})" for p in phrases) + ")"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]"


def _words(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\s+'), lambda x: x <> ''))"


_TYPE = "CASE " + " ".join(f"WHEN {_matches('query', p)} THEN '{k}'" for k, p in rs.QUERY_PATTERNS.items()) + " ELSE 'semantic' END"


@query("text_query_type", f"SELECT ask_id, {_TYPE} AS query_type FROM (SELECT ask_id, query FROM asked UNION ALL SELECT 100000 + conv_id * 1000 + turn, text FROM conversations WHERE text IS NOT NULL)", "asked")
def text_query_type(t: Tables) -> DataFrame:
    turns = t.conversations.filter("text is not null").select((100000 + F.col("conv_id") * 1000 + F.col("turn")).alias("ask_id"), F.col("text").alias("query"))
    return t.asked.unionByName(turns).select("ask_id", rs.query_type(F.col("query")).alias("query_type"))


_ROUTED = f"""
WITH q AS (SELECT ask_id, query, {_TYPE} AS kind FROM asked WHERE query <> ''), words AS (SELECT ask_id, kind, query, list_filter({_words('query')}, lambda x: length(x) > 3) AS w FROM q),
sym AS (SELECT ask_id, p_partkey, 0 AS src, row_number() OVER (PARTITION BY ask_id ORDER BY p_partkey) AS k FROM words, part WHERE kind IN ('symbolic', 'hybrid') AND contains(lower(query), lower(split_part(p_name, ' ', 1)))),
sem AS (SELECT ask_id, p_partkey, 1 AS src, row_number() OVER (PARTITION BY ask_id ORDER BY p_size DESC, p_partkey) AS k FROM words, part WHERE kind IN ('semantic', 'hybrid') AND contains(lower(query), lower(split_part(p_name, ' ', 2)))),
legs AS (SELECT *, row_number() OVER (PARTITION BY ask_id, p_partkey ORDER BY src) AS nth FROM (SELECT * FROM sym WHERE k <= 5 UNION ALL SELECT * FROM sem WHERE k <= 5))
SELECT ask_id, p_partkey, place::INTEGER AS place FROM (SELECT ask_id, p_partkey, row_number() OVER (PARTITION BY ask_id ORDER BY src, k) AS place FROM legs WHERE nth = 1) WHERE place <= 5"""


@query("search_routed", "WITH asks AS (SELECT 1 AS ask_id, 'why is the ' || max(p_name) || ' like that' AS query FROM part UNION ALL SELECT 2, 'find ' || min(p_name) FROM part UNION ALL SELECT 3, 'who made the ' || min(p_name) FROM part)" + _ROUTED.replace("WITH q AS", ", q AS").replace("FROM asked WHERE", "FROM asks WHERE").strip())
def search_routed(t: Tables) -> DataFrame:
    """Each question by its route: names that it holds (symbolic), ranked kinds (semantic), or both, the first route's first.

    Three questions are what is broadcast.
    """
    ends = t.part.agg(F.max("p_name").alias("most"), F.min("p_name").alias("least"))
    asks = ends.select(F.explode(F.array(
        F.struct(F.lit(1).alias("ask_id"), F.concat(F.lit("why is the "), "most", F.lit(" like that")).alias("query")), F.struct(F.lit(2).alias("ask_id"), F.concat(F.lit("find "), "least").alias("query")), F.struct(F.lit(3).alias("ask_id"), F.concat(F.lit("who made the "), "least").alias("query")),
    )).alias("x")).select("x.*")
    asks = F.broadcast(asks.withColumn("kind", rs.query_type(F.col("query"))))

    def leg(kinds: list[str], word: int, order: list, source: int) -> DataFrame:
        hits = t.part.join(asks, F.col("kind").isin(kinds) & F.lower("query").contains(F.lower(F.split_part("p_name", F.lit(" "), F.lit(word)))))
        return hits.withColumn("k", F.row_number().over(W.partitionBy("ask_id").orderBy(*order))).filter("k <= 5").select("ask_id", "p_partkey", F.lit(source).alias("src"), "k")

    both = leg(["symbolic", "hybrid"], 1, ["p_partkey"], 0).union(leg(["semantic", "hybrid"], 2, [F.desc("p_size"), "p_partkey"], 1))
    first = both.groupBy("ask_id", "p_partkey").agg(F.min(F.struct("src", "k")).alias("b"))
    place = F.row_number().over(W.partitionBy("ask_id").orderBy("b.src", "b.k"))
    return first.select("ask_id", "p_partkey", place.alias("place")).filter("place <= 5")


@query("text_should_challenge", rf"""
SELECT claim_id, CASE WHEN coalesce(flag, '') = 'skip_challenge' THEN FALSE WHEN coalesce(flag, '') = 'force_challenge' THEN TRUE WHEN coalesce(flag, '') = 'trusted_source' THEN FALSE WHEN coalesce(memory_type, '') NOT IN ('', 'semantic') THEN FALSE
  WHEN {_matches("lower(trim(content))", rs.NO_CLAIM)} THEN FALSE WHEN {_matches("lower(trim(content))", rs.CLAIM)} THEN TRUE
  WHEN len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) < 4 THEN FALSE ELSE coalesce(source IN ('user_input', 'llm_generated', 'external_api'), FALSE) END AS challenge
FROM (SELECT * FROM claims UNION ALL SELECT 1000 + item_id, content, memory_type, source, NULL FROM items WHERE content IS NOT NULL)""", "claims items")
def text_should_challenge(t: Tables) -> DataFrame:
    more = t.items.filter("content is not null").select((F.col("item_id") + 1000).alias("claim_id"), "content", "memory_type", "source", F.lit(None).cast("string").alias("flag"))
    return t.claims.unionByName(more).select("claim_id", rs.should_challenge(*(F.col(c) for c in ("content", "memory_type", "source", "flag"))).alias("challenge"))


_NEGATED = lambda x, y: "(" + " OR ".join(f"(contains({x}, {_quoted(n)}) AND contains({y}, {_quoted(p)}) AND NOT contains({y}, {_quoted(n)}))" for n, p in rs.NEGATIONS) + ")"
_NUMBERS = lambda c: rf"list_sort(list_distinct(regexp_extract_all({c}, '\b\d+(?:\.\d+)?\b')))"
_COMMON = lambda stop: f"len(list_filter(list_intersect({_words('existing')}, {_words('fresh')}), lambda x: NOT list_contains({_list(stop)}, x)))"
_HEURISTIC = f"""CASE WHEN {_NEGATED("lower(fresh)", "lower(existing)")} OR {_NEGATED("lower(existing)", "lower(fresh)")} THEN 0.7::DOUBLE
  WHEN len({_NUMBERS("existing")}) > 0 AND len({_NUMBERS("fresh")}) > 0 AND {_NUMBERS("existing")} <> {_NUMBERS("fresh")} AND {_COMMON(rs.CONTEXT_STOP)} >= 2 THEN 0.6::DOUBLE END"""
_VALUE = lambda c, p: rf"regexp_extract(lower({c}), '{p}\s+(\w+(?:\s+\w+)?)', 1)"
_FUNCTIONAL = f"CASE WHEN {_COMMON(rs.FACT_STOP)} >= 2 AND (" + " OR ".join(f"({_VALUE('existing', p)} <> '' AND {_VALUE('fresh', p)} <> '' AND {_VALUE('existing', p)} <> {_VALUE('fresh', p)})" for p in rs.FUNCTIONAL) + ") THEN 0.85::DOUBLE END"
_EMBEDDING = f"CASE WHEN similarity >= 0.75 AND {_holds('lower(existing)', rs.NEGATIVE)} <> {_holds('lower(fresh)', rs.NEGATIVE)} THEN least(0.9, similarity) END"


def _of_facts(t: Tables, f, *columns: str) -> DataFrame:
    return t.facts.select("fact_id", f(*(F.col(c) for c in columns)).alias("confidence"))


@fixture("conflict_negation", f"SELECT fact_id, {_HEURISTIC} AS confidence FROM facts", "facts")
def conflict_negation(t: Tables) -> DataFrame:
    return _of_facts(t, rs.negation_conflict, "existing", "fresh")


@fixture("conflict_functional", f"SELECT fact_id, {_FUNCTIONAL} AS confidence FROM facts", "facts")
def conflict_functional(t: Tables) -> DataFrame:
    return _of_facts(t, rs.functional_conflict, "existing", "fresh")


@fixture("conflict_embedding", f"SELECT fact_id, {_EMBEDDING} AS confidence FROM facts", "facts")
def conflict_embedding(t: Tables) -> DataFrame:
    return _of_facts(t, rs.embedding_conflict, "existing", "fresh", "similarity")


@fixture("conflict_recency_resolution", f"SELECT fact_id, CASE WHEN seen_at IS NOT NULL AND {_holds('lower(fresh)', rs.RECENT)} THEN 0.65::DOUBLE END AS confidence FROM facts", "facts")
def conflict_recency_resolution(t: Tables) -> DataFrame:
    return _of_facts(t, rs.newer_wins, "fresh", "seen_at")


_DETECTED = f"SELECT *, {_FUNCTIONAL} AS g, {_EMBEDDING} AS e, {_HEURISTIC} AS h FROM facts"


@fixture("conflict_detection", f"SELECT fact_id, CASE WHEN g IS NOT NULL THEN 'graph' WHEN e IS NOT NULL THEN 'embedding' WHEN h IS NOT NULL THEN 'heuristic' END AS method, coalesce(g, e, h) AS confidence FROM ({_DETECTED})", "facts")
def conflict_detection(t: Tables) -> DataFrame:
    return t.facts.select("fact_id", rs.detect_conflict(F.col("existing"), F.col("fresh"), F.col("similarity")).alias("c")).select("fact_id", "c.*")


@fixture("conflict_challenge_result", f"""
SELECT part, count(coalesce(g, e, h)) AS n_conflicts, round(CASE WHEN count(coalesce(g, e, h)) = 0 THEN 1.0 ELSE greatest(0, 1 - 0.5 * sum(coalesce(g, e, h)) / count(coalesce(g, e, h))) END::DOUBLE, 3) AS confidence
FROM (SELECT *, fact_id % 4 AS part FROM ({_DETECTED})) GROUP BY part""", "facts")
def conflict_challenge_result(t: Tables) -> DataFrame:
    c = rs.detect_conflict(F.col("existing"), F.col("fresh"), F.col("similarity"))["confidence"]
    found = t.facts.select((F.col("fact_id") % 4).alias("part"), c.alias("c")).groupBy("part").agg(F.count("c").alias("n_conflicts"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("total"))
    return found.select("part", "n_conflicts", rs.challenge_confidence(F.col("total"), F.col("n_conflicts")).alias("confidence"))


@query("belief_challenge_confidence", "SELECT owner, round(CASE WHEN count(*) FILTER (WHERE contradicting > 0) = 0 THEN 1.0 ELSE greatest(0, 1 - 0.5 * (sum(confidence) FILTER (WHERE contradicting > 0)) / count(*) FILTER (WHERE contradicting > 0)) END::DOUBLE + 1e-9, 3) AS confidence FROM decisions GROUP BY 1", "decisions")
def belief_challenge_confidence(t: Tables) -> DataFrame:
    hit = F.col("contradicting") > 0
    n = t.decisions.groupBy("owner").agg(F.count_if(hit).alias("n"), F.coalesce(F.sum(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("total"))
    return n.select("owner", F.round(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), 1 - 0.5 * F.col("total") / F.col("n"))).otherwise(1.0) + 1e-9, 3).alias("confidence"))


@query("belief_fuzzy_confidence", """
SELECT decision_id, CASE WHEN p THEN 0.0 ELSE round(ev, 4) END AS evidence, CASE WHEN p THEN 0.0 ELSE round(re, 4) END AS recency, CASE WHEN p THEN 0.0 ELSE round(co, 4) END AS consensus, CASE WHEN p THEN 0.0 ELSE di END AS directness, CASE WHEN p THEN 0.0 ELSE round(0.3 * ev + 0.2 * re + 0.3 * co + 0.2 * di, 4) END AS combined
FROM (SELECT decision_id, status = 'pending' AS p, least(1.0, supporting / 5)::DOUBLE AS ev, pow(0.5::DOUBLE, (epoch(TIMESTAMP '2024-01-31') - epoch(created_at)) / 86400 / 90) AS re,
  CASE WHEN supporting + contradicting > 0 THEN supporting::DOUBLE / (supporting + contradicting) ELSE 0.5::DOUBLE END AS co, CASE WHEN decision_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS di FROM decisions)""", "decisions")
def belief_fuzzy_confidence(t: Tables) -> DataFrame:
    parts = rs.fuzzy_confidence(F.col("supporting"), days_before(F.col("created_at")), F.col("supporting"), F.col("contradicting"), F.col("decision_id") % 2 == 0, F.col("status") == "pending")
    return t.decisions.select("decision_id", *[c.alias(k) for k, c in parts.items()])


@query("belief_confidence_history", """
WITH h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id, event_id, k::INTEGER AS k, round(greatest(0, 1 - 0.1 * (k - 1))::DOUBLE, 6) AS before, round(greatest(0, 1 - 0.1 * k)::DOUBLE, 6) AS after FROM h WHERE k > n - 20""")
def belief_confidence_history(t: Tables) -> DataFrame:
    """Every error takes a tenth off a user's confidence; the last twenty events of the history stay."""
    by = W.partitionBy("user_id")
    h = t.events.filter("event_type = 'error'").select("user_id", "event_id", F.row_number().over(by.orderBy("ts", "event_id")).alias("k"), F.row_number().over(by.orderBy(F.desc("ts"), F.desc("event_id"))).alias("back"))
    left = lambda k: F.round(F.greatest(F.lit(0.0), 1 - 0.1 * k), 6)
    return h.filter("back <= 20").select("user_id", "event_id", "k", left(F.col("k") - 1).alias("before"), left(F.col("k")).alias("after"))


_KIND = "CASE " + " ".join(f"WHEN {_holds('lower(content)', p)} THEN '{k}'" for k, p in rs.DECISION_KINDS.items()) + " ELSE 'inference' END"


@query("text_decision_kind", f"SELECT note_id, {_KIND} AS kind FROM notes WHERE content IS NOT NULL", "notes")
def text_decision_kind(t: Tables) -> DataFrame:
    rows = t.notes.filter("content is not null")
    return rows.select("note_id", rs.decision_kind(F.col("content")).alias("kind"))


_SAID = " UNION ALL ".join(rf"SELECT note_id, {k} AS nth, '{kind}' AS kind, unnest(regexp_extract_all(content, {_quoted(rf'(?i)(?:^|[.!?]\s+)([^.!?]*\b(?:{words})\b[^.!?]*[.!?]?)')}, 1)) AS raw FROM notes WHERE length(trim(content)) >= 20" for k, (words, kind) in enumerate(rs.DECISION_SENTENCES))


@query("text_decisions", f"""
SELECT note_id, arg_min(content, nth) AS content, arg_min(kind, nth) AS kind FROM (SELECT note_id, nth, kind, trim(rtrim(trim(raw), '.!?')) AS content FROM ({_SAID})) WHERE length(content) >= 20 GROUP BY note_id, lower(content)""", "notes")
def text_decisions(t: Tables) -> DataFrame:
    return t.notes.select("note_id", F.explode(rs.stated_decisions(F.col("content"))).alias("d")).select("note_id", "d.content", "d.kind")


@query("text_reasoning_steps", """
SELECT * FROM (VALUES (6::BIGINT, 0, 'thought', 'the cache is cold'), (6, 1, 'action', 'warm the cache up'), (6, 2, 'observation', 'hits went up'), (6, 3, 'conclusion', 'keep it warm'), (7, 0, 'thought', 'one'), (7, 1, 'thought', 'one'), (7, 2, 'observation', 'done'),
  (8, 0, 'decision', 'only one step here that is a little longer than thirty characters')) v(note_id, place, kind, content)""")
def text_reasoning_steps(t: Tables) -> DataFrame:
    return t.notes.select("note_id", F.posexplode(rs.reasoning_steps(F.col("content"))).alias("place", "s")).select("note_id", "place", "s.kind", "s.content")


@query("text_reasoning_quality", "SELECT * FROM (VALUES (6::BIGINT, round(least(1.0, 1 - 0.2 + 4 / 6 * 0.2 + 0.2)::DOUBLE, 6), TRUE), (7, round((1 - 0.2 - 0.1 - 0.2 + 2 / 6 * 0.2 + 0.15)::DOUBLE, 6), TRUE), (8, round(least(1.0, 1 + 1 / 6 * 0.2 + 0.05)::DOUBLE, 6), TRUE)) v(note_id, quality, stored)")
def text_reasoning_quality(t: Tables) -> DataFrame:
    q = t.notes.select("note_id", rs.reasoning_quality(rs.reasoning_steps(F.col("content"))).alias("quality")).filter("quality is not null")
    return q.select("note_id", "quality", (F.col("quality") >= 0.4).alias("stored"))


@query("stage_reasoning_detect", r"SELECT item_id, length(content) >= 50 AND regexp_matches(lower(content), 'because|therefore|step') AS reasons FROM items WHERE content IS NOT NULL", "items")
def stage_reasoning_detect(t: Tables) -> DataFrame:
    """Texts of fifty characters or more that show signs of reasoning."""
    c = F.col("content")
    return t.items.filter("content is not null").select("item_id", ((F.length(c) >= 50) & F.lower(c).rlike("because|therefore|step")).alias("reasons"))


@fixture("text_query_tokens", rf"""
SELECT ask_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '''s$', ''), '[^0-9a-z_]', '', 'g'))), lambda x: x <> '' AND NOT list_contains({_list(tx.STOP_WORDS)}, x))), ',') AS tokens FROM asked""", "asked")
def text_query_tokens(t: Tables) -> DataFrame:
    return t.asked.select("ask_id", F.array_join(F.sort_array(tx.query_tokens(F.col("query"))), ",").alias("tokens"))
