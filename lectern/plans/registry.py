"""All queries of the retrieval part."""

from __future__ import annotations

from lectern.plans import chunk_queries, search_queries, talk_queries, word_queries
from lectern.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chunk_queries", "search_queries", "talk_queries", "word_queries"]
