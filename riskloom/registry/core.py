"""Registry of queries over the given tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.registry.oracle_bindings import BINDINGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Approximate queries, whose rows no SQL can name; the contract offers them beside the others.
APPROXIMATE: dict[str, Query] = {}


def with_bindings(*names: str, body: str) -> str:
    """SQL with the named bindings (and what they build on) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in BINDINGS[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


def query(name: str, *bindings: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is its SQL over the named bindings, none for an approximate query."""

    def register(fn: Query) -> Query:
        if name in QUERIES or name in APPROXIMATE:
            raise ValueError(f"query {name} registered twice")
        (APPROXIMATE if oracle is None else QUERIES)[name] = fn
        if oracle is not None:
            text = with_bindings(*bindings, body=oracle)
            if bindings and oracle.lstrip().upper().startswith("WITH "):
                text = with_bindings(*bindings, body="").rstrip() + ",\n" + oracle.lstrip()[5:]
            ORACLES[name] = text
        return fn

    return register
