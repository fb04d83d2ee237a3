"""Routing of queries, challenging of claims, conflict detection and resolution, and what texts decide or reason, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Patterns of queries by the way they are answered, in the order they are tried.
QUERY_PATTERNS = {
    "hybrid": [r"^(why|how|explain)\b", r"\b(reason|cause|because|decision)\b"],
    "semantic": [r"\b(similar|related|about|like|regarding)\b", r"\b(find|search|look for)\b"],
    "symbolic": [r"^(who|what|where|when)\b", r"\b(list all|count|how many)\b", r"\b(is .+ a|does .+ have)\b"],
}
# What isn't a claim, and what is one.
NO_CLAIM = [
    r"^(?:I|we|you)\s+(?:think|feel|believe|want|need|like|love|hate)", r"^(?:maybe|perhaps|possibly|probably|might)", r"\?$", r"^(?:hello|hi|hey|thanks|thank you|please|sorry)",
    r"^(?:let's|let us|can you|could you|would you)", r"^(?:I'm|I am)\s+(?:going|trying|working|looking)", r"(?:today|yesterday|tomorrow|now|currently|right now)",
]
CLAIM = [
    r"\b(?:is|are|was|were)\s+(?:the|a|an)\b", r"\b(?:is|are|was|were)\s+\d", r"\b(?:has|have|had)\s+\d", r"\b(?:equals?|=)\b", r"\b(?:capital|president|CEO|founder|inventor)\s+of\b",
    r"\b(?:born|died|founded|created|invented)\s+(?:in|on)\b", r"\b(?:located|situated)\s+in\b", r"\b(?:contains?|consists?\s+of)\b", r"\b(?:always|never|every|all|none)\b",
]
CHALLENGED_TYPES, UNTRUSTED = ["semantic"], ["user_input", "llm_generated", "external_api"]
# Negations and what they negate.
NEGATIONS = [("is not", "is"), ("isn't", "is"), ("are not", "are"), ("aren't", "are"), ("was not", "was"), ("wasn't", "was"), ("does not", "does"), ("doesn't", "does"), ("cannot", "can"), ("can't", "can"), ("never", "always"), ("false", "true")]
# Words that are no context of a number.
CONTEXT_STOP = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once",
    "and", "but", "or", "nor", "so", "yet", "both", "either", "neither", "not", "only", "own", "same", "than", "too", "very", "just",
]
# Properties with one value, and words that no two facts share by themselves.
FUNCTIONAL = ["capital of", "president of", "ceo of", "founder of", "born in", "died in", "located in", "headquarters in"]
FACT_STOP = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "or"]
# Words of negative polarity, and of recency.
NEGATIVE = ["not", "n't", "never", "no", "none", "neither", "nobody", "nothing", "nowhere", "cannot", "can't", "won't", "wouldn't", "shouldn't", "couldn't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "false", "incorrect", "wrong", "impossible"]
RECENT = ["now", "currently", "as of", "today", "recent"]
# Keywords of kinds of decision, in the order they are tried.
DECISION_KINDS = {
    "preference": ["prefer", "preference", "favorite", "favour", "favor", "like using", "i like"], "choice": ["decided", "decision", "chose", "choose", "go with", "selected", "picked"], "belief": ["believe", "i think"],
    "policy": ["should always", "always", "never", "rule is", "must"], "inference": ["therefore", "this means", "in conclusion", "thus", "hence", "consequently"], "classification": ["this is a", "falls into", "belongs to", "categorize", "classify"],
}
# Keywords of sentences that state a decision.
DECISION_SENTENCES = [
    ("i prefer|my preference is|i favor", "preference"), ("my favorite|i like using|i like", "preference"), ("i decided|my decision is|i chose|i choose|i'll go with", "choice"), ("i believe|i think that", "belief"),
    ("we should always|always|never|the rule is", "policy"), ("therefore|in conclusion|thus|this means", "inference"), ("this is a|this falls into|this belongs to", "classification"),
]
# Markers of reasoning steps.
STEP_MARKERS = {
    "thought": "thought|thinking|i think|let me think", "action": "action|doing|let me", "observation": "observation|result|output|i see|i notice",
    "decision": "decision|i will|i'll|decided", "conclusion": "conclusion|therefore|thus|in conclusion|finally", "reflection": "reflection|looking back|in hindsight",
}


def matches(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, (text.rlike(f"(?i){p}") for p in patterns))


def holds(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, (text.contains(p) for p in phrases))


def query_type(text: Column) -> Column:
    """hybrid, semantic or symbolic, by the first group with a matching pattern; semantic if none has."""
    out = F.lit("semantic")
    for kind in reversed(QUERY_PATTERNS):
        out = F.when(matches(text, QUERY_PATTERNS[kind]), kind).otherwise(out)
    return out


def should_challenge(content: Column, memory_type: Column, source: Column, flag: Column) -> Column:
    """Flags decide, then the type, then patterns of what is no claim and of what is one, then length and source."""
    low = F.lower(F.trim(content))
    return (
        F.when(flag.isin("skip_challenge"), False).when(flag.isin("force_challenge"), True).when(flag.isin("trusted_source"), False)
        .when(F.coalesce(memory_type, F.lit("")).isin("", *CHALLENGED_TYPES) == F.lit(False), False)
        .when(matches(low, NO_CLAIM), False).when(matches(low, CLAIM), True).when(F.size(tx.words(content)) < 4, False).otherwise(F.coalesce(source.isin(UNTRUSTED), F.lit(False)))
    )


def _shared(a: Column, b: Column, stop: list[str]) -> Column:
    return F.size(F.array_except(F.array_intersect(tx.tokens(a), tx.tokens(b)), F.array(*[F.lit(x) for x in stop])))


def negation_conflict(existing: Column, fresh: Column) -> Column:
    """0.7 where one text negates what the other says, 0.6 where their numbers differ in a common context, else null."""
    old, new = F.lower(existing), F.lower(fresh)
    one_way = lambda x, y: reduce(or_, (x.contains(neg) & y.contains(pos) & ~y.contains(neg) for neg, pos in NEGATIONS))
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b\d+(?:\.\d+)?\b"), 0)))
    a, b = numbers(existing), numbers(fresh)
    differ = (F.size(a) > 0) & (F.size(b) > 0) & (a != b) & (_shared(old, new, CONTEXT_STOP) >= 2)
    return F.when(one_way(new, old) | one_way(old, new), 0.7).when(differ, 0.6)


def functional_conflict(existing: Column, fresh: Column) -> Column:
    """0.85 where a property that has one value has two, else null."""
    old, new = F.lower(existing), F.lower(fresh)
    value = lambda c, p: F.regexp_extract(c, rf"{p}\s+(\w+(?:\s+\w+)?)", 1)
    differ = reduce(or_, ((value(old, p) != "") & (value(new, p) != "") & (value(old, p) != value(new, p)) for p in FUNCTIONAL))
    return F.when((_shared(old, new, FACT_STOP) >= 2) & differ, 0.85)


def embedding_conflict(existing: Column, fresh: Column, similarity: Column) -> Column:
    """The similarity, 0.9 at most, where it is 0.75 or more and one text alone is negative, else null."""
    return F.when((similarity >= 0.75) & (holds(F.lower(existing), NEGATIVE) != holds(F.lower(fresh), NEGATIVE)), F.least(F.lit(0.9), similarity))


def detect_conflict(existing: Column, fresh: Column, similarity: Column) -> Column:
    """(method, confidence) of the first detector that finds one: graph, embedding, heuristic."""
    found = {"graph": functional_conflict(existing, fresh), "embedding": embedding_conflict(existing, fresh, similarity), "heuristic": negation_conflict(existing, fresh)}
    method = reduce(lambda out, k: F.when(found[k].isNotNull(), k).otherwise(out), reversed(found), F.lit(None).cast("string"))
    return F.struct(method.alias("method"), F.coalesce(*found.values()).alias("confidence"))


def challenge_confidence(total: Column, n: Column) -> Column:
    """1 without conflicts, else 1 less half their mean confidence."""
    return F.round(F.when(n > 0, F.greatest(F.lit(0.0), 1 - 0.5 * total / n)).otherwise(1.0), 3)


def newer_wins(fresh: Column, seen_at: Column) -> Column:
    return F.when(seen_at.isNotNull() & holds(F.lower(fresh), RECENT), 0.65)


def fuzzy_confidence(evidence: Column, age_days: Column, reinforced: Column, contradicted: Column, provenance: Column, pending: Column) -> dict[str, Column]:
    """evidence, recency, consensus, directness and their weighted sum; all 0 while a decision is pending."""
    n = reinforced + contradicted
    parts = {
        "evidence": F.least(F.lit(1.0), evidence / 5.0), "recency": F.coalesce(F.pow(F.lit(0.5), age_days / 90.0), F.lit(0.5)),
        "consensus": F.when(n > 0, reinforced / n).otherwise(0.5), "directness": F.when(provenance, 1.0).otherwise(0.5),
    }
    parts = {k: F.when(pending, 0.0).otherwise(c) for k, c in parts.items()}
    whole = 0.3 * parts["evidence"] + 0.2 * parts["recency"] + 0.3 * parts["consensus"] + 0.2 * parts["directness"]
    return {k: F.round(c, 4) for k, c in (parts | {"combined": whole}).items()}


def decision_kind(text: Column) -> Column:
    low, out = F.lower(text), F.lit("inference")
    for kind in reversed(DECISION_KINDS):
        out = F.when(holds(low, DECISION_KINDS[kind]), kind).otherwise(out)
    return out


def stated_decisions(text: Column, least: int = 20) -> Column:
    """array<struct<content, kind>>: sentences with the keywords of a decision, each content once, at its first kind."""

    def of(words: str, kind: str) -> Column:
        # fixed value: the frame of a sentence with keywords
        raw = F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|[.!?]\s+)([^.!?]*\b(?:{words})\b[^.!?]*[.!?]?)"), 1)
        bare = F.transform(raw, lambda x: F.trim(F.rtrim(F.trim(x), F.lit(".!?"))))
        return F.transform(F.filter(bare, lambda x: F.length(x) >= least), lambda x: F.struct(x.alias("content"), F.lit(kind).alias("kind")))

    every = F.when(F.length(F.trim(text)) >= least, F.concat(*(of(*x) for x in DECISION_SENTENCES))).otherwise(F.array().cast("array<struct<content:string,kind:string>>"))
    names = F.transform(every, lambda x: F.lower(x["content"]))
    return F.filter(every, lambda x, k: F.array_position(names, F.lower(x["content"])) == k + 1)


def reasoning_steps(text: Column) -> Column:
    """array<struct<kind, content>>: what follows each line marker, up to the next one, in order; 1000 characters at most."""
    every = "|".join(STEP_MARKERS.values())
    # one mark before each marker's line, then a split at the marks
    marked = F.split(F.regexp_replace(text, rf"(?i)(^|\n)\s*({every}):\s*", "\u0001$2:"), "\u0001")
    part = F.filter(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), lambda x: x != "")
    kind = lambda x: F.coalesce(*[F.when(F.lower(F.split_part(x, F.lit(":"), F.lit(1))).rlike(f"^(?:{p})$"), k) for k, p in STEP_MARKERS.items()])
    steps = F.transform(part, lambda x: F.struct(kind(x).alias("kind"), F.substring(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), 1, 1000).alias("content")))
    return F.filter(steps, lambda x: x["content"] != "")


def reasoning_quality(steps: Column) -> Column:
    """1, less what repeated (0.2), nearly equal (0.1) and short (0.2) steps cost, more for kinds and number; 0 to 1."""
    heads = F.transform(steps, lambda x: F.substring(F.lower(x["content"]), 1, 100))
    loops = F.size(F.array_distinct(heads)) < F.size(heads)
    similar = F.exists(heads, lambda x: F.exists(heads, lambda y: (x != y) & (tx.jaccard(tx.tokens(x), tx.tokens(y)) > 0.8))) | loops
    mean = F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.length(x["content"])) / F.size(steps)
    kinds = F.size(F.array_distinct(F.transform(steps, lambda x: x["kind"])))
    score = 1 - F.when(loops, 0.2).otherwise(0.0) - F.when(similar, 0.1).otherwise(0.0) - F.when(mean < 30, 0.2).otherwise(0.0) + kinds / 6 * 0.2 + F.least(F.size(steps), F.lit(6)) * 0.05
    return F.when(F.size(steps) > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
