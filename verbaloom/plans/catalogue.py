"""All queries of the core over the test tables, and the same in DuckDB's SQL."""

from verbaloom.plans import exchange, lint, memory, notes, segment, status, terms
from verbaloom.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "exchange", "lint", "memory", "notes", "segment", "status", "terms"]
