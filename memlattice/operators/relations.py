"""Relations and ontology: normalising labels, validating type pairs and constraints, scoring, promoting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.text import predicate_key

from .graph import dealt

#: What a label becomes that no alias covers.
DEFAULT_RELATION = "related_to"


def normalise(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """relations (predicate, ...) with canonical and match: 1.0 where aliases(alias, canonical) has the label's key, else 0.0.

    aliases has one row a key; the join is by equality, so it may be of any size.
    """
    index = aliases.select(predicate_key(F.col("alias")).alias("key"), "canonical").dropDuplicates(["key"])
    joined = relations.withColumn("key", predicate_key(F.col("predicate"))).join(index, "key", "left")
    return joined.withColumn("match", F.when(F.col("canonical").isNotNull(), 1.0).otherwise(0.0)).withColumn("canonical", F.coalesce("canonical", F.lit(DEFAULT_RELATION))).drop("key")


def normalise_by_vectors(relations: DataFrame, aliases: DataFrame, types: DataFrame, embed: Callable[[Column], Column], least: float = 0.75) -> DataFrame:
    """normalise, and for labels that no alias covers the nearest of types (canonical, embedding): canonical with its cosine.

    embed makes a vector of a label's key with spaces for underscores; only distinct labels are embedded.  types is the
    ontology's list of relations, a short one, which travels to every task.  A cosine below `least`, a vector of another
    length, or a null, empty or zero one, leave DEFAULT_RELATION and 0.0; of equally near types the smaller name counts.
    """
    if {"near", "label"} & set(relations.columns):
        raise ValueError("near and label are columns of the operator's own")
    known = normalise(relations, aliases)
    labels = known.filter(F.col("match") == 0.0).select(predicate_key(F.col("predicate")).alias("label")).filter("label <> ''").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    listed = types.agg(F.collect_list(F.struct("canonical", "embedding")).alias("types"))
    vectors = labels.withColumn("v", embed(F.translate("label", "_", " "))).join(F.broadcast(listed), F.lit(True))
    v = F.col("v")

    def scored(t: Column) -> Column:
        cosine = F.try_divide(dot(v, t["embedding"]), F.sqrt(dot(v, v) * dot(t["embedding"], t["embedding"])))
        return F.struct(F.coalesce(-F.when(F.size(v) == F.size(t["embedding"]), cosine), F.lit(0.0)).alias("far"), t["canonical"].alias("canonical"))

    best = vectors.select("label", F.array_min(F.transform("types", scored)).alias("near")).filter(F.col("near.far") <= -least)
    joined = known.withColumn("_label", F.when(F.col("match") == 0.0, predicate_key(F.col("predicate")))).join(best, F.col("_label") == F.col("label"), "left")
    out = joined.withColumns({"canonical": F.coalesce("near.canonical", "canonical"), "match": F.coalesce(-F.col("near.far"), "match")})
    return out.drop("_label", "label", "near")


def validate_pairs(relations: DataFrame, priors: DataFrame) -> DataFrame:
    """relations (source_type, canonical, target_type, ...) with pair_score from priors (source_type, canonical, target_type).

    Exact pairs and those with one wildcard (*) score 1, any-to-any ones 0.8, a known pair of types with another relation
    0.5, all else 0.
    """
    p = priors.select(F.col("source_type").alias("ps"), F.col("canonical").alias("pc"), F.col("target_type").alias("pt"))
    s, c, t = (relations[k] for k in ("source_type", "canonical", "target_type"))

    def marked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """One row for each key, so that no join below adds rows."""
        return rows.select(*[F.col(k).alias(f"{name}_{k}") for k in keys]).distinct().withColumn(name, F.lit(True))

    key = {"ps": s, "pc": c, "pt": t}
    kinds = {
        "exact": (p, ["ps", "pc", "pt"]), "any_source": (p.filter("ps = '*'"), ["pc", "pt"]), "any_target": (p.filter("pt = '*'"), ["ps", "pc"]),
        "any_pair": (p.filter("ps = '*' and pt = '*'"), ["pc"]), "known": (p, ["ps", "pt"]),
    }
    out = relations
    for name, (rows, keys) in kinds.items():
        side = marked(rows, keys, name)
        on = [key[k] == side[f"{name}_{k}"] for k in keys]
        out = out.join(side, reduce(and_, on), "left").drop(*[f"{name}_{k}" for k in keys])
    one = F.coalesce("exact", "any_source", "any_target")
    score = F.when(one, 1.0).when(F.col("any_pair"), 0.8).when(F.col("known"), 0.5).otherwise(0.0)
    return out.withColumn("pair_score", score).drop(*kinds)


def plausibility(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of scores, clamped to 0..1; null scores don't weigh."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(total > 0, value / total).otherwise(0.0)))


def candidates(seen: DataFrame) -> DataFrame:
    """(name, kind, n, confidence, consistency) of sightings (name, kind, confidence): the most frequent kind (of equals the
    greatest by name) and its share, the mean confidence.  Pre-aggregated by name and kind, so no task holds a name's rows;
    a null kind is a kind of its own, null confidences don't count, a null name has no row."""
    kinds = seen.filter("name is not null").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("k"), F.sum("confidence").alias("s"), F.count("confidence").alias("c"))
    top = F.max_by("kind", F.struct("k", "kind")).alias("kind")
    return kinds.groupBy("name").agg(top, F.sum("k").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("confidence"), (F.max("k") / F.sum("k")).alias("consistency"))


def promotion_gate(name: Column, confidence: Column, frequency: Column, consistency: Column, blocked: list[str]) -> Column:
    """The first gate that a candidate type fails, or promoted."""
    return (
        F.when(F.length(F.trim(name)) < 3, "length").when(F.lower(F.trim(name)).isin(blocked), "blocklist").when(confidence < 0.7, "confidence").when(frequency < 2, "frequency").when(consistency < 0.8, "consistency").otherwise("promoted")
    )


def constraint_violations(entities: DataFrame, constraints: DataFrame) -> DataFrame:
    """(entity_id, property, problem, hard) for entities (entity_id, entity_type, props map) and constraints
    (entity_type, property, required, kind, allowed array, cardinality, hard)."""
    rows = entities.join(constraints, "entity_type").withColumn("value", F.try_element_at("props", F.col("property")))
    v, many = F.col("value"), F.col("value").contains("|")
    fits = F.when(F.col("kind") == "number", v.try_cast("double").isNotNull()).when(F.col("kind") == "date", v.try_cast("date").isNotNull()).when(F.col("kind") == "boolean", F.lower(v).isin("true", "false")).when(F.col("kind") == "enum", F.array_contains("allowed", v)).otherwise(True)
    problem = F.when(v.isNull(), F.when(F.col("required"), "missing")).when((F.col("cardinality") == "one") & many, "cardinality").when(~fits, "type")
    return rows.withColumn("problem", problem).filter("problem is not null").select("entity_id", "property", "problem", "hard")


def edge_problems(edges: DataFrame, nodes: DataFrame, schemas: DataFrame, rows: int | None = None) -> DataFrame:
    """edges, `rows` at most, with problem (null if none): blank ids or type, ends that don't exist, or a pair of types that
    schemas (edge_type, source_type, target_type) doesn't allow for a type that it knows."""
    kinds = dealt(nodes.select("item_id", "memory_type"), rows, "item_id")
    end = lambda k: kinds.select(F.col("item_id").alias(k), F.col("memory_type").alias(f"{k}_type"))
    known = schemas.select(F.col("edge_type").alias("k_type")).distinct().withColumn("known", F.lit(True))
    allowed = schemas.select("edge_type", F.col("source_type").alias("src_type"), F.col("target_type").alias("dst_type")).distinct().withColumn("allowed", F.lit(True))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    # blank ids are told before the joins, which need not carry the other end then where no column asks for it
    told = edges.withColumn("blank", blank("src") | blank("dst"))
    rows = told.join(end("src"), "src", "left").join(end("dst"), "dst", "left").join(known, F.col("edge_type") == F.col("k_type"), "left").join(allowed, ["edge_type", "src_type", "dst_type"], "left")
    problem = F.when(F.col("blank"), "blank id").when(blank("edge_type"), "blank type").when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "missing end").when(F.col("known") & F.col("allowed").isNull(), "not allowed")
    return rows.select(*edges.columns, problem.alias("problem"))


def route(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """(event_id, evolver): evolvers that triggers (memory_type, operation, evolver) starts for an event; null matches all."""
    t = triggers.select(F.col("memory_type").alias("t_type"), F.col("operation").alias("t_op"), "evolver")
    exact = events.join(t.filter("t_type is not null"), (F.col("memory_type") == F.col("t_type")) & (F.col("operation") == F.col("t_op")))
    every = events.join(t.filter("t_type is null"), F.col("operation") == F.col("t_op"))
    return exact.select("event_id", "evolver").union(every.select("event_id", "evolver")).distinct()


def governance_violations(entities: DataFrame, relations: DataFrame, needs: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, violation, severity, fixable) of entities (item_id, entity_type, props) by needs (entity_type, property) and of
    relations (item_id, relation) by known (relation); the ontology's tables are joined by equality, whatever their size."""
    kinds = needs.select("entity_type").distinct()
    unknown = entities.join(kinds, "entity_type", "left_anti").select("item_id", F.lit("unknown_entity_type").alias("violation"), F.lit("medium").alias("severity"), F.lit(False).alias("fixable"))
    lacking = entities.join(needs, "entity_type").filter(F.try_element_at("props", F.col("property")).isNull())
    lacking = lacking.select("item_id", F.concat(F.lit("missing_property:"), "property"), F.lit("high"), F.lit(True))
    strange = relations.join(known, "relation", "left_anti").select("item_id", F.concat(F.lit("unknown_relation:"), "relation"), F.lit("medium"), F.lit(False))
    return unknown.union(lacking).union(strange)


# The types of memory.
MEMORY_TYPES = ["semantic", "episodic", "procedural", "zettel", "working", "decision", "reasoning"]


def item_issues(content: Column, memory_type: Column, confidence: Column, decision_id: Column, trace_id: Column) -> Column:
    """array<struct<severity, field>>: blank content, unknown type, confidence out of range, a missing id of a decision or trace."""
    issue = lambda when, severity, field: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field")))
    kind = F.coalesce(memory_type, F.lit(""))
    return F.array_compact(F.array(
        issue(F.coalesce(F.trim(content), F.lit("")) == "", "error", "content"), issue(~kind.isin(MEMORY_TYPES), "warning", "memory_type"), issue(~confidence.between(0, 1), "error", "confidence"),
        issue((kind == "decision") & decision_id.isNull(), "warning", "decision_id"), issue((kind == "reasoning") & trace_id.isNull(), "warning", "trace_id"),
    ))
