"""All queries of the library and their oracles."""

from . import aggregate_queries, dataset_queries, evidence_queries, join_queries, layout_queries, ordered_queries, score_queries

_PARTS = (ordered_queries, join_queries, aggregate_queries, evidence_queries, score_queries, dataset_queries, layout_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
