"""Queries of the library and their DuckDB twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query function ``(spark, sf_dir) -> DataFrame`` with the SQL that must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep
