"""The registered queries of the library and their SQL."""

from __future__ import annotations

from . import relational, textual

PARTS = (relational, textual)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in PARTS for k, q in part.ORACLES.items()}


def flagship(spark, sf_dir: str):
    """The full retrieval job: candidates, typed rows, deduplication, reranking, the best of each query."""
    return textual.r17_retrieve(spark, sf_dir)
