"""Named runs of the operators over the test tables, each with its independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# Common table expressions of the SQL side, by name: (names it uses, text).
COMMON: dict[str, tuple[tuple[str, ...], str]] = {}


# those that a query reads more than once and that are costly
SHARED = {"syn", "outcome"}


def common(name: str, text: str, *uses: str) -> None:
    COMMON[name] = (uses, text)


def with_common(body: str, *uses: str) -> str:
    """``body`` behind a WITH chain of what it uses, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in COMMON[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    if not ordered:
        return body
    chain = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({COMMON[n][1]})" for n in ordered)
    return f"WITH {chain}\n{body}"


def query(key: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a run under ``key``; ``sql`` omitted means rows-only."""

    def register(run: Run) -> Run:
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Entry(run, None if sql is None else with_common(sql, *uses))
        return run

    return register
