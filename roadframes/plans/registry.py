"""The catalogue of queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            TWINS[fn.__name__] = sql
        return fn

    return add


def r6(column, name: str | None = None) -> Column:
    """Six digits, so that the order of a floating sum does not show."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6).alias(name) if name else F.round(column, 6)


def weighed(pixels: str | Column = "pixels", digits: int | None = None) -> Column:
    """Position-weighted sum of an array: changes with any value or order."""
    parts = F.transform(pixels, lambda v, i: v.cast("double") * (i + 1))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return total.cast("bigint") if digits is None else F.round(total, digits)
