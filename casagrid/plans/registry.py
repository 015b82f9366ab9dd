"""Registry of the queries offered to the driver and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casagrid.sources.projections import PROJECTIONS, projection_sql

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}

# Shared sub-queries of the checking SQL: name -> (text, names it depends on).
SHARED: dict[str, tuple[str, tuple[str, ...]]] = {
    name: (projection_sql(name), ()) for name in PROJECTIONS
}


def shared(name: str, sql: str, *needs: str) -> None:
    SHARED[name] = (sql, needs)


def with_shared(body: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SHARED[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    head = ", ".join(f"{n} as ({SHARED[n][0]})" for n in order)
    word = "with recursive" if recursive else "with"
    body = body.strip()
    if body.lower().startswith("with recursive "):
        body, word = body[len("with recursive "):], "with recursive"
        return f"{word} {head}, {body}" if head else f"{word} {body}"
    if body.lower().startswith("with "):
        body = body[len("with "):]
        return f"{word} {head}, {body}" if head else f"{word} {body}"
    return f"{word} {head} {body}" if head else body


def query(name: str, covers: str, oracle: str | None = None, uses: tuple[str, ...] = (), recursive: bool = False):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if oracle is not None:
            ORACLE[name] = with_shared(oracle, *uses, recursive=recursive)
        return fn

    return register
