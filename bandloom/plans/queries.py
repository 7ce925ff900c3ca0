"""All named queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from bandloom.plans import measured, stores, views  # noqa: F401  (their queries)
from bandloom.plans.catalog import QUERIES
from bandloom.plans.oracles import ORACLE_SQL as SQL
from bandloom.plans.store_oracles import ORACLE_SQL as STORE_SQL

ORACLE_SQL = SQL | STORE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
