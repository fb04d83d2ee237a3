"""Functions of single values: extracted names and tools, prices, merged maps, flattened documents, names of patterns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Names that are known without a model of entities.
KNOWN_NAMES = ["Microsoft", "Google", "Python", "TensorFlow", "Seattle"]
KNOWN_ORGANISATIONS = ["Google", "Google Inc", "Microsoft", "Amazon", "OpenAI", "Apple"]
ORGANISATION_MARKS = ["Inc", "Corp", "LLC", "Ltd", "Company"]
# Types of entity by their synonyms.
TYPE_NAMES = {
    "organization": "org", "org": "org", "company": "org", "corporation": "org", "business": "org", "person": "person", "people": "person", "human": "person", "individual": "person",
    "location": "location", "place": "location", "city": "location", "country": "location", "concept": "concept", "idea": "concept", "topic": "concept", "event": "event", "product": "product",
    "technology": "technology", "tech": "technology", "nationality": "nationality", "language": "language", "award": "award", "work_of_art": "work_of_art", "temporal": "temporal",
}
# Prices of 1000 tokens read and written by beginnings of model names; "" is the default.
PRICES = {
    "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-5": (0.01, 0.03), "gpt-5-mini": (0.001, 0.003), "llama-3.3-70b-versatile": (0.00059, 0.00079),
    "llama-3.1-8b-instant": (0.00005, 0.00008), "gemini-2.0-flash": (0.0001, 0.0004), "claude-3-5-haiku": (0.001, 0.005), "": (0.001, 0.002),
}


def tools(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(?:use|using|used) ([a-zA-Z0-9_\-]+)"), 1))


def skills(text: Column) -> Column:
    lists = F.regexp_extract_all(text, F.lit(r"(?i)skill[s]?: ([a-zA-Z0-9_,\- ]+)"), 1)
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != ""))


def named_entities(text: Column) -> Column:
    """Runs of capitalised words, and known names."""
    known = F.filter(F.array(*[F.lit(x) for x in KNOWN_NAMES]), lambda x: text.contains(x))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1), known))


def guessed_kind(name: Column) -> Column:
    parts = F.size(F.split(name, r"\s+"))
    organisation = name.rlike("|".join(ORGANISATION_MARKS)) | name.isin(KNOWN_ORGANISATIONS)
    capitals = F.forall(F.split(name, r"\s+"), lambda x: x.rlike("^[A-Z]"))
    return F.when(organisation, "organization").when((parts == 2) & capitals, "person").when((parts == 1) & capitals, "organization").otherwise("concept")


def simple_clauses(text: Column) -> Column:
    """array<string>: sentences split at conjunctions; relative clauses after commas as sentences of their own."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    clauses = F.flatten(F.transform(sentences, lambda s: F.split(s, r"\s+(?:and|but|or)\s+")))
    pattern = r"(\w+), (?:which|who) ([^,]+),"
    relative = F.transform(F.filter(sentences, lambda s: s.rlike(pattern)), lambda s: F.concat_ws(" ", F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)))
    return F.filter(F.transform(F.concat(clauses, relative), lambda x: F.trim(x)), lambda x: x != "")


def resolve_coreference(rows: DataFrame, column: str, resolver: object = None) -> DataFrame:
    """rows with the column's mentions resolved by a function of a Column; as they are without one."""
    return rows.withColumn(column, resolver(F.col(column))) if resolver else rows


def dummy_embedding(text: Column, dims: int = 32) -> Column:
    """Bytes of the text's digest as numbers from 0 to 1."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substr(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def flatten_json(doc: Column, depth: int = 5, sep: str = "__") -> Column:
    """map<string,string> of a JSON document's leaves by their joined keys; empty objects have none."""
    kind = "map<string,string>"
    flat = F.from_json(doc, kind)
    for _ in range(depth):
        entries = F.map_entries(flat)
        nested = lambda e: e["value"].startswith("{")
        inner = F.flatten(F.transform(F.filter(entries, nested), lambda e: F.transform(F.map_entries(F.from_json(e["value"], kind)), lambda x: F.struct(F.concat(e["key"], F.lit(sep), x["key"]).alias("key"), x["value"].alias("value")))))
        flat = F.map_from_entries(F.concat(F.filter(entries, lambda e: ~F.coalesce(nested(e), F.lit(False))), inner))
    return flat


def unflatten_json(rows: DataFrame, key: str, flat: str, sep: str = "__") -> DataFrame:
    """(key, doc): the JSON text of nested objects, keys in order, from a JSON text of joined keys and string leaves; Arrow-batched."""

    def nested(text: str) -> str:
        out: dict = {}
        for name, value in sorted(json.loads(text).items()):
            *path, leaf = name.split(sep)
            at = out
            for part in path:
                at = at.setdefault(part, {})
            at[leaf] = value
        return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "doc": frame[flat].map(nested, na_action="ignore")})

    return rows.select(key, flat).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, doc string")


def merge_metadata(base: Column, more: Column) -> Column:
    """Both maps' keys; the base value unless it is missing or empty."""
    keys = F.array_distinct(F.concat(F.map_keys(base), F.map_keys(more)))
    value = lambda k: F.coalesce(F.when(F.try_element_at(base, k) != "", F.try_element_at(base, k)), F.try_element_at(more, k))
    return F.map_from_arrays(keys, F.transform(keys, value))


def parse_time(text: Column) -> Column:
    """ISO dates and times; null for what can't be read."""
    return text.try_cast("timestamp_ntz")


def token_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """By the longest price name that the model's name begins with."""
    price = reduce(lambda out, m: F.when(F.coalesce(model, F.lit("")).startswith(m), F.array(*map(F.lit, PRICES[m]))).otherwise(out), sorted(PRICES, key=len), F.array(F.lit(0.0), F.lit(0.0)))
    return prompt / 1000.0 * price[0] + completion / 1000.0 * price[1]


def plan_score(steps: Column, feedback: Column) -> Column:
    """Length (ten at most) and variety of a plan, less 2 if it repeats itself, 2 up or down for each good or bad word of feedback."""
    distinct = F.size(F.array_distinct(steps))
    said = F.aggregate(feedback, F.lit(0), lambda a, x: a + F.when(F.lower(x).contains("good"), 2).when(F.lower(x).contains("bad"), -2).otherwise(0))
    return F.when(F.size(steps) == 0, 0).otherwise(F.least(F.size(steps), F.lit(10)) + distinct - F.when(distinct < F.size(steps), 2).otherwise(0) + said)


def schema_hashes(rows: DataFrame) -> DataFrame:
    """(tool, digest): of the canonical JSON of each tool's properties (tool, property, type, required)."""
    entry = F.struct("property", F.concat(F.lit('"'), "property", F.lit('":{"required":'), F.col("required").cast("string"), F.lit(',"type":"'), "type", F.lit('"}')).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"])
    return rows.groupBy("tool").agg(F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256).alias("digest"))


def drift_confidence(confidence: Column, drifted: Column, multiplier: float) -> Column:
    return F.when(drifted, confidence * multiplier).otherwise(confidence)


def safe_label(text: Column) -> Column:
    """Other characters than letters, digits and underscores to underscores; one before a leading digit."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), "^([0-9])", "_$1")


def entity_type(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(kind))), F.lit("concept"))


def singular_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(tx.clean(name)), "([^s])s$", "$1")


def pattern_name(tool: Column, word: Column, verb: str = "Processing", most: int = 50) -> Column:
    """Tool, verb and word in title case, the word unless it is the tool; Pattern after a short name, dots for a cut one."""
    title = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))
    name = F.concat(title(tool), F.lit(f" {verb}"), F.when(word != F.lower(tool), F.concat(F.lit(" "), title(word))).otherwise(""))
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).when(F.length(name) < 15, F.concat(name, F.lit(" Pattern"))).otherwise(name)


def content_types(text: Column, keywords: dict[str, list[str]]) -> Column:
    low = F.lower(text)
    has = lambda xs: reduce(lambda a, b: a | b, (low.contains(x) for x in xs))
    return F.array_compact(F.array(*[F.when(has(xs), kind) for kind, xs in keywords.items()]))


def chosen_type(explicit: Column, types: Column, priority: tuple[str, ...] = ("working", "procedural", "episodic", "semantic")) -> Column:
    """The explicit type, else the first by priority among those that are no zettel, else zettel."""
    return F.coalesce(explicit, *[F.when(F.array_contains(types, p), p) for p in priority], F.lit("zettel"))
