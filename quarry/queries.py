"""All registered queries outside the llm subpackage, and their DuckDB oracles."""

from __future__ import annotations

from .plans import answers, assembled, chained, chunk_sql, cleaning, collection, drawing, hybrid, indexed, metadata, modality, quality, requests, retrieval, review, structure  # noqa: F401  each registers its queries
from .plans.oracles import ORACLES
from .plans.registry import QUERIES

__all__ = ["ORACLES", "QUERIES"]
