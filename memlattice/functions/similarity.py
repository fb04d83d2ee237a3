"""The similarity framework: pairwise metrics of memories as column expressions, and their weighted combination."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .scores import temporal_proximity

# Words that conceptual similarity leaves out.
COMMON = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# Words of temporal patterns.
TEMPORAL = [
    "morning", "afternoon", "evening", "night", "daily", "weekly", "monthly", "yearly", "before", "after", "during", "while",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
# Phrases of the kinds of relationship.
RELATIONSHIPS = {
    "causal": ["causes", "leads to", "results in", "because of", "due to", "triggers", "produces"],
    "temporal": ["before", "after", "during", "while", "when", "then", "next"],
    "similarity": ["similar to", "like", "resembles", "comparable to"],
    "difference": ["different from", "unlike", "opposite to", "contrasts with"],
    "containment": ["contains", "includes", "part of", "belongs to", "within"],
}
# Vocabularies of agent workflows.
SEQUENTIAL = ["step", "phase", "stage", "first", "second", "third", "next", "then", "after", "before", "initially", "subsequently", "finally", "begin", "start", "continue", "complete"]
PROBLEM = ["issue", "problem", "error", "bug", "fail", "failure", "exception", "crash", "broken", "wrong", "incorrect", "missing", "unable", "cannot", "difficulty", "challenge", "stuck", "slow", "slowly", "running", "queries"]
SOLUTION = ["fix", "solve", "resolve", "implement", "add", "update", "correct", "repair", "address", "solution", "answer", "workaround", "patch", "improvement", "enhancement", "success", "added", "indexes", "designed", "based"]
LEARNING = ["learn", "understand", "discover", "realize", "figure", "research", "study", "explore", "attempt", "try", "experiment", "test", "practice", "improve", "progress", "master", "initial", "failed", "successfully", "implemented"]
TECHNICAL = [
    "api", "database", "query", "function", "method", "class", "module", "service", "endpoint", "authentication", "authorization", "oauth", "jwt", "token", "session", "cache", "index",
    "algorithm", "optimization", "performance", "scaling", "deployment", "configuration", "queries", "columns", "indexes", "system", "architecture", "requirements", "feature",
]
ORDER_WORDS = ["first", "second", "third", "next", "then", "after"]
FAILURE = ["fail", "failed", "failure", "unsuccessful", "unable", "cannot", "error"]
SUCCESS = ["success", "successful", "successfully", "completed", "achieved", "solved"]
DATABASE, LOGIN, DESIGN = ["database", "queries", "indexes", "columns"], ["authentication", "oauth", "jwt", "token"], ["system", "architecture", "requirements", "feature"]
# Weights of the metrics, and the boost of a strong workflow match.
WEIGHTS = {"content": 0.20, "semantic": 0.25, "temporal": 0.15, "graph": 0.15, "metadata": 0.10, "workflow": 0.15}
STRONG, BOOST, REDUCED = 0.7, 1.5, 0.8


def _words(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _has_any(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, (text.contains(x) for x in phrases))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of distinct arrays, 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def fuzzy(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Distinct words of four letters or more: 0.5 for one within the other, 0.3 for nearly equal ones, over the larger set."""
    x, y = tx.tokens(a), tx.tokens(b)
    long = lambda w: F.filter(w, lambda v: F.length(v) >= 4)

    def of(u: Column, v: Column) -> Column:
        return F.when(u.contains(v) | v.contains(u), 0.5).when(tx.positional_similarity(u, v) > threshold, 0.3).otherwise(0.0)

    total = F.aggregate(long(x), F.lit(0.0), lambda s, u: s + F.aggregate(long(y), F.lit(0.0), lambda t, v: t + of(u, v)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), total / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def content(a: Column, b: Column) -> Column:
    best = F.greatest(set_similarity(tx.tokens(a), tx.tokens(b)), 0.8 * fuzzy(a, b))
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), F.least(F.lit(1.0), best + 0.1 * tx.length_ratio(a, b))).otherwise(0.0)


def conceptual(a: Column, b: Column) -> Column:
    key = lambda c: F.array_except(F.filter(tx.tokens(c), lambda x: F.length(x) > 3), _words(COMMON))
    return set_similarity(key(a), key(b))


def temporal_patterns(a: Column, b: Column) -> Column:
    key = lambda c: F.array_intersect(tx.tokens(c), _words(TEMPORAL))
    return set_similarity(key(a), key(b))


def temporal(seconds: Column, a: Column, b: Column) -> Column:
    """Nine parts nearness in time (0 where a time is missing), one part shared temporal words."""
    return 0.9 * F.coalesce(temporal_proximity(F.abs(seconds)), F.lit(0.0)) + 0.1 * temporal_patterns(a, b)


def entities(text: Column) -> Column:
    """Words over two characters that begin with a capital, without marks at their ends."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x.rlike("^[A-Z]") & (F.length(x) > 2))
    return F.array_distinct(F.transform(raw, lambda x: F.btrim(x, F.lit(".,!?"))))


def relationship_kinds(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(_has_any(low, phrases), kind) for kind, phrases in RELATIONSHIPS.items()]))


def graph(a: Column, b: Column, near_a: Column, near_b: Column) -> Column:
    """Shared entities, kinds of relationship, and neighbours."""
    return 0.4 * set_similarity(entities(a), entities(b)) + 0.3 * set_similarity(relationship_kinds(a), relationship_kinds(b)) + 0.3 * set_similarity(F.array_distinct(near_a), F.array_distinct(near_b))


def metadata(kinds: tuple[Column, Column], tags: tuple[Column, Column], categories: tuple[Column, Column], confidences: tuple[Column, Column]) -> Column:
    """Equal types, shared tags, equal categories that are not blank, near confidences (1 where missing)."""
    none = F.lit("")
    same_kind = F.when(F.coalesce(kinds[0], none) == F.coalesce(kinds[1], none), 1.0).otherwise(0.0)
    same_category = F.when((F.coalesce(categories[0], none) != "") & (categories[0] == categories[1]), 1.0).otherwise(0.0)
    nearness = 1 - F.abs(F.coalesce(confidences[0], F.lit(1.0)) - F.coalesce(confidences[1], F.lit(1.0)))
    return 0.3 * same_kind + 0.3 * set_similarity(F.array_distinct(tags[0]), F.array_distinct(tags[1])) + 0.2 * same_category + 0.2 * nearness


class _Side:
    """What a text shows of a workflow."""

    def __init__(self, text: Column):
        self.low = F.lower(F.coalesce(text, F.lit("")))
        words = tx.tokens(text)
        of = lambda xs: F.array_intersect(words, _words(xs))
        flag = lambda phrases, name: F.when(_has_any(self.low, phrases), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        self.sequential, self.technical = of(SEQUENTIAL), of(TECHNICAL)
        self.problem = F.concat(of(PROBLEM), flag(["running slowly", "queries are"], "*slow"))
        self.solution = F.concat(of(SOLUTION), flag(["added indexes", "solution:"], "*done"))
        self.learning = F.concat(of(LEARNING), flag(["initial attempt"], "*tried"), flag(["successfully implemented"], "*managed"))
        self.numbered = self.low.rlike("step [1-9]")
        self.ordered = F.size(of(ORDER_WORDS)) > 0
        self.asks, self.answers = self.low.startswith("issue:"), self.low.startswith("solution:")
        self.has_problem, self.has_solution = F.size(self.problem) > 0, F.size(self.solution) > 0

    def says(self, phrases: list[str]) -> Column:
        return _has_any(self.low, phrases)


def workflow(a: Column, b: Column) -> Column:
    """The best of the workflow patterns that two texts form (numbered steps, problem and solution, learning), else a blend."""
    x, y = _Side(a), _Side(b)
    shared = F.size(F.array_intersect(x.technical, y.technical)) > 0
    either = lambda f: f(x, y) | f(y, x)
    one = F.lit(1.0)

    in_order = set_similarity_of_union(x.sequential, y.sequential)
    sequential = F.when(x.numbered & y.numbered, 0.9).when(F.size(F.array_union(x.sequential, y.sequential)) == 0, 0.0).otherwise(F.least(one, in_order + F.when(x.ordered & y.ordered, 0.2).otherwise(0.0)))

    wrong, right = lambda s: s.has_problem | s.asks, lambda s: s.has_solution | s.answers
    answered = either(lambda s, t: wrong(s) & right(t) & ~right(s))
    alike = ((wrong(x) & wrong(y)) | (right(x) & right(y))) & ((F.size(F.array_intersect(x.problem, y.problem)) > 0) | (F.size(F.array_intersect(x.solution, y.solution)) > 0))
    implied = either(lambda s, t: s.says([*FAILURE, "issue"]) & t.says([*SUCCESS, "solution"]))
    solved = F.when(answered, F.when(shared, 0.95).otherwise(0.8)).when(alike, 0.6).when(implied, F.when(shared, 0.85).otherwise(0.6)).otherwise(0.0)

    overcome = either(lambda s, t: s.says(FAILURE) & t.says(SUCCESS))
    any_learning = (F.size(x.learning) > 0) | (F.size(y.learning) > 0)
    learned = F.when(overcome, F.least(one, 0.6 + F.when(shared, 0.2).otherwise(0.0) + F.when(any_learning, 0.1).otherwise(0.0))).otherwise(set_similarity_of_union(x.learning, y.learning))

    field = lambda xs: (F.size(F.array_intersect(x.technical, _words(xs))) > 0) & (F.size(F.array_intersect(y.technical, _words(xs))) > 0)
    technical = F.greatest(set_similarity_of_union(x.technical, y.technical), F.when(field(DATABASE) | field(LOGIN), 0.8).when(field(DESIGN), 0.7).otherwise(0.0))

    is_sequence = (x.numbered & y.numbered) | ((F.size(x.sequential) > 0) & (F.size(y.sequential) > 0) & shared)
    is_answer = either(lambda s, t: s.asks & t.answers) | (either(lambda s, t: s.has_problem & t.has_solution & ~s.has_solution) & shared)
    is_lesson = either(lambda s, t: s.says([*FAILURE, "initial attempt"]) & t.says(SUCCESS)) & (shared | any_learning)
    best = F.greatest(
        F.when(is_sequence, 0.9 * sequential + 0.1 * technical), F.when(is_answer, 0.9 * solved + 0.1 * technical), F.when(is_lesson, 0.8 * learned + 0.2 * technical)
    )
    blend = 0.3 * sequential + 0.4 * solved + 0.2 * learned + 0.1 * technical
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(F.least(one, F.coalesce(best, blend)))


def set_similarity_of_union(a: Column, b: Column) -> Column:
    """Jaccard of distinct arrays, 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def combined(scores: dict[str, Column]) -> Column:
    """Weighted mean; a strong workflow match weighs more and all else less.  Rounded to six places."""
    strong = scores["workflow"] > STRONG
    weight = {k: F.when(strong, w * (BOOST if k == "workflow" else REDUCED)).otherwise(w) for k, w in WEIGHTS.items() if k in scores}
    return F.round(sum((weight[k] * scores[k] for k in weight), F.lit(0.0)) / sum(weight.values(), F.lit(0.0)), 6)


def agreement(scores: list[Column]) -> Column:
    """1 less the population variance of the scores."""
    mean = sum(scores, F.lit(0.0)) / len(scores)
    return F.greatest(F.lit(0.0), 1 - sum(((s - mean) * (s - mean) for s in scores), F.lit(0.0)) / len(scores))
