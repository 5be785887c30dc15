"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a ``(spark, sf_dir) -> DataFrame`` under ``name``, with its oracle."""

    def put(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return put
