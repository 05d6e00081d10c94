"""Where queries and their oracle SQL are registered side by side."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a (spark, sf_dir) function under its name, with DuckDB SQL for the same rows."""

    def put(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return put
