"""Named queries over the star-schema test tables and their SQL counterparts."""

from daywright.catalog.oracle import oracle_sql
from daywright.catalog.queries import queries

__all__ = ["oracle_sql", "queries"]
