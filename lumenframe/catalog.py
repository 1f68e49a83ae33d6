"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, collection, frames, reports, retrieval, texts

__all__ = ["ORACLE_SQL", "QUERIES", "collection", "frames", "reports", "retrieval", "texts"]
