"""Queries of the similarity framework: pairs of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions import similarity as sm
from memlattice.functions import text as tx
from memlattice.operators import search as s
from memlattice.sources.tables import Tables

from .registry import query


def _words(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\s+'), lambda x: x <> ''))"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _near(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in phrases) + ")"


_ALIKE = "1 - (abs(length(x) - length(y)) + len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))))::DOUBLE / greatest(length(x), length(y))"
_FUZZY = f"""(CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN coalesce(list_sum(list_transform(list_filter(wa, lambda x: length(x) >= 4), lambda x: coalesce(list_sum(list_transform(list_filter(wb, lambda y: length(y) >= 4),
  lambda y: CASE WHEN contains(x, y) OR contains(y, x) THEN 0.5::DOUBLE WHEN {_ALIKE} > 0.8 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)), 0))), 0) / greatest(len(wa), len(wb)) ELSE 0.0 END)"""
_BONUS = "(CASE WHEN greatest(length(a), length(b)) > 0 THEN 1 - abs(length(a) - length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 1.0 END)"
_CONTENT = f"(CASE WHEN coalesce(a, '') <> '' AND coalesce(b, '') <> '' THEN least(1.0, greatest({_near('wa', 'wb')}, 0.8 * {_FUZZY}) + 0.1 * {_BONUS}) ELSE 0.0 END)"
_CONCEPTS = _near(*(f"list_filter({w}, lambda x: length(x) > 3 AND NOT list_contains({_list(sm.COMMON)}, x))" for w in ("wa", "wb")))
_PATTERNS = _near(*(f"list_filter({w}, lambda x: list_contains({_list(sm.TEMPORAL)}, x))" for w in ("wa", "wb")))
_PROXIMITY = """(CASE WHEN dt IS NULL THEN 0.0 WHEN dt < 60 THEN 0.95 WHEN dt < 3600 THEN 0.8 * exp(-dt / 1800) WHEN dt < 86400 THEN 0.6 * exp(-(dt - 3600) / 7200) WHEN dt < 604800 THEN 0.3 * exp(-(dt - 86400) / 172800) ELSE 0.1 * exp(-(dt - 604800) / 1209600) END)"""
_TEMPORAL = f"(0.9 * {_PROXIMITY} + 0.1 * {_PATTERNS})"


def _capitals(c: str) -> str:
    return rf"list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce({c}, ''), '\s+'), lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 2), lambda x: trim(x, '.,!?')))"


def _kinds(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(f'lower({c})', phrases)} THEN '{k}' END" for k, phrases in sm.RELATIONSHIPS.items()) + "], lambda x: x IS NOT NULL)"


_GRAPH = f"(0.4 * {_near(_capitals('a'), _capitals('b'))} + 0.3 * {_near(_kinds('a'), _kinds('b'))} + 0.3 * {_near('near_a', 'near_b')})"
_METADATA = f"(0.3 * CASE WHEN coalesce(type_a, '') = coalesce(type_b, '') THEN 1 ELSE 0 END + 0.3 * {_near('tags_a', 'tags_b')} + 0.2 * CASE WHEN coalesce(cat_a, '') <> '' AND cat_a = cat_b THEN 1 ELSE 0 END + 0.2 * (1 - abs(coalesce(conf_a, 1) - coalesce(conf_b, 1))))"


def _side(c: str) -> str:
    of = lambda xs: f"list_filter(w{c}, lambda x: list_contains({_list(xs)}, x))"
    flag = lambda phrases, name: f"CASE WHEN {_any(f'lower({c})', phrases)} THEN ['{name}'] ELSE [] END"
    return f"""lower({c}) AS low_{c}, {of(sm.SEQUENTIAL)} AS seq_{c}, {of(sm.TECHNICAL)} AS tech_{c}, list_concat({of(sm.PROBLEM)}, {flag(["running slowly", "queries are"], "*slow")}) AS prob_{c},
    list_concat({of(sm.SOLUTION)}, {flag(["added indexes", "solution:"], "*done")}) AS sol_{c}, list_concat(list_concat({of(sm.LEARNING)}, {flag(["initial attempt"], "*tried")}), {flag(["successfully implemented"], "*managed")}) AS learn_{c},
    regexp_matches(lower({c}), 'step [1-9]') AS num_{c}, len({of(sm.ORDER_WORDS)}) > 0 AS ord_{c}, starts_with(lower({c}), 'issue:') AS asks_{c}, starts_with(lower({c}), 'solution:') AS ans_{c}"""


def _either(f: str) -> str:
    """A condition of X and Y, or of the two swapped."""
    return f"({f.replace('_X', '_a').replace('_Y', '_b')} OR {f.replace('_X', '_b').replace('_Y', '_a')})"


_FIELD = lambda xs: f"(len(list_intersect(tech_a, {_list(xs)})) > 0 AND len(list_intersect(tech_b, {_list(xs)})) > 0)"
_WRONG, _RIGHT = "(len(prob_{0}) > 0 OR asks_{0})", "(len(sol_{0}) > 0 OR ans_{0})"
_WORKFLOW = f"""
sides AS (SELECT *, {_side("a")}, {_side("b")} FROM base),
parts AS (SELECT *, len(list_intersect(tech_a, tech_b)) > 0 AS shared, len(learn_a) > 0 OR len(learn_b) > 0 AS any_learning,
  CASE WHEN num_a AND num_b THEN 0.9 WHEN len(seq_a) + len(seq_b) = 0 THEN 0.0 ELSE least(1.0, {_near("seq_a", "seq_b")} + CASE WHEN ord_a AND ord_b THEN 0.2 ELSE 0.0 END) END AS sequential,
  {_either(_WRONG.format("X") + " AND " + _RIGHT.format("Y") + " AND NOT " + _RIGHT.format("X"))} AS answered,
  (({_WRONG.format("a")} AND {_WRONG.format("b")}) OR ({_RIGHT.format("a")} AND {_RIGHT.format("b")})) AND (len(list_intersect(prob_a, prob_b)) > 0 OR len(list_intersect(sol_a, sol_b)) > 0) AS alike,
  {_either(_any("low_X", [*sm.FAILURE, "issue"]) + " AND " + _any("low_Y", [*sm.SUCCESS, "solution"]))} AS implied, {_either(_any("low_X", sm.FAILURE) + " AND " + _any("low_Y", sm.SUCCESS))} AS overcome,
  greatest({_near("tech_a", "tech_b")}, CASE WHEN {_FIELD(sm.DATABASE)} OR {_FIELD(sm.LOGIN)} THEN 0.8 WHEN {_FIELD(sm.DESIGN)} THEN 0.7 ELSE 0.0 END) AS technical FROM sides),
scored AS (SELECT *, CASE WHEN answered THEN CASE WHEN shared THEN 0.95 ELSE 0.8 END WHEN alike THEN 0.6 WHEN implied THEN CASE WHEN shared THEN 0.85 ELSE 0.6 END ELSE 0.0 END AS solved,
  CASE WHEN overcome THEN least(1.0, 0.6 + CASE WHEN shared THEN 0.2 ELSE 0.0 END + CASE WHEN any_learning THEN 0.1 ELSE 0.0 END) ELSE {_near("learn_a", "learn_b")} END AS learned FROM parts),
flows AS (SELECT *, CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0 ELSE least(1.0, coalesce(greatest(
  CASE WHEN (num_a AND num_b) OR (len(seq_a) > 0 AND len(seq_b) > 0 AND shared) THEN 0.9 * sequential + 0.1 * technical END,
  CASE WHEN {_either("asks_X AND ans_Y")} OR ({_either("len(prob_X) > 0 AND len(sol_Y) > 0 AND len(sol_X) = 0")} AND shared) THEN 0.9 * solved + 0.1 * technical END,
  CASE WHEN {_either(_any("low_X", [*sm.FAILURE, "initial attempt"]) + " AND " + _any("low_Y", sm.SUCCESS))} AND (shared OR any_learning) THEN 0.8 * learned + 0.2 * technical END),
  0.3 * sequential + 0.4 * solved + 0.2 * learned + 0.1 * technical)) END AS workflow FROM scored)"""
_BASE = f"base AS (SELECT *, {_words('a')} AS wa, {_words('b')} AS wb, abs(epoch(tb) - epoch(ta)) AS dt FROM pairs)"


def _sql(expr: str) -> str:
    return f"WITH {_BASE} SELECT pair_id, round(({expr})::DOUBLE, 6) AS score FROM base"


def _seconds() -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros("tb") - micros("ta")) / 1e6


def _scores() -> dict[str, Column]:
    both = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    a, b = F.col("a"), F.col("b")
    return {
        "content": sm.content(a, b), "semantic": sm.conceptual(a, b), "temporal": sm.temporal(_seconds(), a, b), "graph": sm.graph(a, b, *both("near")),
        "metadata": sm.metadata(both("type"), both("tags"), both("cat"), both("conf")), "workflow": sm.workflow(a, b),
    }


def _scored(t: Tables, score: Column) -> DataFrame:
    return t.pairs.select("pair_id", F.round(score.cast("double"), 6).alias("score"))


@query("pair_fuzzy_words", _sql(_FUZZY), "pairs")
def pair_fuzzy_words(t: Tables) -> DataFrame:
    return _scored(t, sm.fuzzy(F.col("a"), F.col("b")))


@query("pair_length_bonus", _sql(f"coalesce({_BONUS}, 1.0)"), "pairs")
def pair_length_bonus(t: Tables) -> DataFrame:
    return _scored(t, F.coalesce(tx.length_ratio(F.col("a"), F.col("b")), F.lit(1.0)))


@query("pair_content", _sql(_CONTENT), "pairs")
def pair_content(t: Tables) -> DataFrame:
    return _scored(t, _scores()["content"])


@query("pair_conceptual", _sql(_CONCEPTS), "pairs")
def pair_conceptual(t: Tables) -> DataFrame:
    return _scored(t, _scores()["semantic"])


@query("pair_temporal_patterns", _sql(_PATTERNS), "pairs")
def pair_temporal_patterns(t: Tables) -> DataFrame:
    return _scored(t, sm.temporal_patterns(F.col("a"), F.col("b")))


@query("pair_temporal", _sql(_TEMPORAL), "pairs")
def pair_temporal(t: Tables) -> DataFrame:
    return _scored(t, _scores()["temporal"])


@query("pair_graph", _sql(_GRAPH), "pairs")
def pair_graph(t: Tables) -> DataFrame:
    return _scored(t, _scores()["graph"])


@query("pair_metadata", _sql(_METADATA), "pairs")
def pair_metadata(t: Tables) -> DataFrame:
    return _scored(t, _scores()["metadata"])


@query("pair_workflow", f"WITH {_BASE}, {_WORKFLOW} SELECT pair_id, round(workflow::DOUBLE, 6) AS score FROM flows", "pairs")
def pair_workflow(t: Tables) -> DataFrame:
    return _scored(t, _scores()["workflow"])


_SIX = f"six AS (SELECT pair_id, {_CONTENT} AS content, {_CONCEPTS} AS semantic, {_TEMPORAL} AS temporal, {_GRAPH} AS graph, {_METADATA} AS metadata, workflow FROM flows)"
_BLEND = "(0.2 * r * content + 0.25 * r * semantic + 0.15 * r * temporal + 0.15 * r * graph + 0.1 * r * metadata + 0.15 * b * workflow) / (0.85 * r + 0.15 * b)"


@query("pair_combined", f"WITH {_BASE}, {_WORKFLOW}, {_SIX} SELECT pair_id, round(({_BLEND})::DOUBLE, 6) AS score FROM (SELECT *, CASE WHEN workflow > 0.7 THEN 0.8 ELSE 1.0 END AS r, CASE WHEN workflow > 0.7 THEN 1.5 ELSE 1.0 END AS b FROM six)", "pairs")
def pair_combined(t: Tables) -> DataFrame:
    rows = t.pairs.select("pair_id", *[c.alias(k) for k, c in _scores().items()])
    return rows.select("pair_id", sm.combined({k: F.col(k) for k in sm.WEIGHTS}).alias("score"))


@query("pair_confidence", f"WITH {_BASE}, {_WORKFLOW}, {_SIX} SELECT pair_id, round(greatest(0, 1 - list_var_pop([content, semantic, temporal, graph, metadata, workflow]::DOUBLE[]))::DOUBLE, 6) AS score FROM six", "pairs")
def pair_confidence(t: Tables) -> DataFrame:
    rows = t.pairs.select("pair_id", *[c.alias(k) for k, c in _scores().items()])
    return rows.select("pair_id", F.round(sm.agreement([F.col(k) for k in sm.WEIGHTS]), 6).alias("score"))


@query("search_similar_items", f"""
WITH one AS (SELECT p_name AS b FROM part WHERE p_partkey = 1), base AS (SELECT p_partkey, p_name AS a, b, {_words("p_name")} AS wa, {_words("b")} AS wb FROM part, one WHERE p_partkey <> 1)
SELECT p_partkey, round(({_CONTENT})::DOUBLE, 6) AS score FROM base WHERE round(({_CONTENT})::DOUBLE, 6) >= 0.3 ORDER BY 2 DESC, 1 LIMIT 10""")
def search_similar_items(t: Tables) -> DataFrame:
    """The ten items most similar to one, itself left out; the one item is what is broadcast."""
    one = t.part.filter("p_partkey = 1").select(F.col("p_name").alias("b")).limit(1)
    rows = t.part.filter("p_partkey <> 1").join(F.broadcast(one), F.lit(True))
    scored = rows.select("p_partkey", F.round(sm.content(F.col("p_name"), F.col("b")), 6).alias("score")).filter("score >= 0.3")
    return s.top_k(scored, 10, key="p_partkey")


@query("search_episode_similarity", f"""
WITH base AS (SELECT p_partkey, p_name AS a, 'red small box of steel' AS b, {_words("p_name")} AS wa, {_words("'red small box of steel'")} AS wb FROM part)
SELECT p_partkey, round((0.5 * {_CONTENT} + 0.5 * {_CONCEPTS})::DOUBLE, 6) AS score FROM base WHERE round((0.5 * {_CONTENT} + 0.5 * {_CONCEPTS})::DOUBLE, 6) > 0.1 ORDER BY 2 DESC, 1 LIMIT 5""")
def search_episode_similarity(t: Tables) -> DataFrame:
    a, b = F.col("p_name"), F.lit("red small box of steel")
    score = F.round(0.5 * sm.content(a, b) + 0.5 * sm.conceptual(a, b), 6)
    return s.top_k(t.part.select("p_partkey", score.alias("score")).filter("score > 0.1"), 5, key="p_partkey")
