"""Every query by name, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.operators.shared import released

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name. What it wrote to the shared folder on the way is removed once it is built;
    what its result still reads stays."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = released(f)
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from fairlead.plans import lattice_queries, point_queries, route_queries  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
