"""All queries over the game log, with their DuckDB twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Decorator: file a query under a name, with the SQL that gives the same rows."""

    def wrap(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return wrap


def queries() -> dict:
    import tipoff.plans  # noqa: F401  (registers)

    return QUERIES


def oracle_sql() -> dict:
    import tipoff.plans  # noqa: F401  (registers)

    return ORACLES
