"""Numeric scores of memories: vectors, decay, reinforcement, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, of another length or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def retention(days: Column, stability: float = 30.0) -> Column:
    return F.exp(-days / F.lit(stability))


def reinforced(confidence: Column, n: Column) -> Column:
    """n reinforcements, each closing a tenth of the gap to 1."""
    return 1 - (1 - confidence) * F.pow(F.lit(0.9), n)


def contradicted(confidence: Column, n: Column) -> Column:
    return confidence * F.pow(F.lit(0.85), n)


def decision_confidence(confidence: Column, supporting: Column, contradicting: Column, idle_days: Column) -> Column:
    """All reinforcements, then all contradictions; without either, 0.05 less after 30 idle days."""
    both = contradicted(reinforced(confidence, supporting), contradicting)
    idle = F.when(idle_days > 30, F.greatest(F.lit(0.0), confidence - 0.05)).otherwise(confidence)
    return F.when(supporting + contradicting > 0, both).otherwise(idle)


def stability(reinforced_n: Column, contradicted_n: Column) -> Column:
    n = reinforced_n + contradicted_n
    return F.when(n > 0, reinforced_n / n).otherwise(0.5)


def temporal_proximity(seconds: Column) -> Column:
    """Five ranges of the time between two memories, each decaying on its own scale."""
    return (
        F.when(seconds < 60, 0.95)
        .when(seconds < 3600, 0.8 * F.exp(-seconds / 1800.0))
        .when(seconds < 86400, 0.6 * F.exp(-(seconds - 3600.0) / 7200.0))
        .when(seconds < 604800, 0.3 * F.exp(-(seconds - 86400.0) / 172800.0))
        .otherwise(0.1 * F.exp(-(seconds - 604800.0) / 1209600.0))
    )


def candidate_frequency(n: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * n / total + 0.6 * F.log1p(n) / F.log1p(total))


def strengthened(base: Column, n: Column, rank: Column, week: Column, month: Column) -> Column:
    """Retrieval strengthening, clamped to 0..1; unretrieved memories lose half a percent a day for 30 days."""
    up = base + 0.1 * F.log1p(n) / (1 + rank) * week / (month + F.lit(1e-6))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 0, up).otherwise(base * (1 - 0.005 * 30))))


def hebbian_boost(n: Column) -> Column:
    return F.least(F.lit(0.3), F.greatest(F.lit(0.0), (n - 3) * 0.02))


def entropy(p: Column) -> Column:
    """A term of the entropy, to be summed."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def opinion_confidence(n: Column, scepticism: float) -> Column:
    """Strength of a pattern seen n times, less for a sceptical disposition, more for evidence."""
    strength = F.least(F.lit(1.0), n / 10.0)
    return strength * (1 - 0.3 * scepticism) * (0.5 + 0.5 * strength)
