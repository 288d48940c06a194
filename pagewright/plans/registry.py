"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import chunk_queries, cleaning_queries, evidence_queries, search_queries, session_queries

FLAGSHIP = "bm25_top5"
_MODULES = [search_queries, cleaning_queries, chunk_queries, session_queries, evidence_queries]
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
