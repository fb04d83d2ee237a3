"""Named queries: a function of the loaded tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlattice.sources.tables import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Operators over literal rows that reach their branches: for the tests, as their work does not grow with any table.
FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXTURE_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: str = "") -> Callable:
    """Registers f(tables) under name; `using` names the derived tables that the SQL reads."""
    return _register(name, sql, using, QUERIES, ORACLES)


def fixture(name: str, sql: str | None = None, using: str = "") -> Callable:
    """The same for an operator that the tests alone run."""
    return _register(name, sql, using, FIXTURES, FIXTURE_ORACLES)


def _register(name: str, sql: str | None, using: str, runs: dict, oracles: dict) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES and name not in FIXTURES, name
        runs[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            oracles[name] = with_tables(sql, using)
        return f

    return register


def with_tables(sql: str, using: str) -> str:
    """sql after the definitions of the derived tables it uses, and of those which they use."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name not in needed:
            for other in PRELUDE[name][0].split():
                need(other)
            needed.append(name)

    for name in using.split():
        need(name)
    if not needed:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    body_ctes = body[len("WITH RECURSIVE") if recursive else 4 :].lstrip() if body.upper().startswith("WITH") else ""
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({PRELUDE[n][1]})" for n in needed)
    return f"{head}, {body_ctes}" if body_ctes else f"{head}\n{body}"
