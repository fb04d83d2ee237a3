"""All registered queries."""

from . import belief_queries, chunk_queries, cluster_queries, corpus_queries, evolve_queries, graph_queries, link_queries, memory_queries, pair_queries, reason_queries, score_queries, store_queries, stream_queries, temporal_queries, text_queries  # noqa: F401
from .registry import FIXTURE_ORACLES, FIXTURES, ORACLES, QUERIES

__all__ = ["FIXTURES", "FIXTURE_ORACLES", "ORACLES", "QUERIES"]
