"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from . import corpus_queries, model_queries, selection_queries, structured_queries, topic_queries  # noqa: F401  registers
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
