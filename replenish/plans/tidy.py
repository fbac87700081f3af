"""Projection of query results to comparable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(column: str | Column, digits: int = 4, name: str | None = None) -> Column:
    """Rounded double; a negative zero becomes zero."""
    col = F.col(column) if isinstance(column, str) else column
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or column) if name or isinstance(column, str) else out


def ts(column: str | Column, name: str | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.date_format(col, pattern).alias(name or column)


def day(column: str, name: str | None = None) -> Column:
    return F.col(column).cast("string").alias(name or column)


def big(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.cast("bigint").alias(name or column)


# The SQL side of ``ts``.
def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
