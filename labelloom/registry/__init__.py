"""The registered queries over the test tables, and SQL that checks them."""

from labelloom.registry.oracle import oracle_sql
from labelloom.registry.queries import queries

__all__ = ["oracle_sql", "queries"]
