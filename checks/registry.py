"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    value = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return value.alias(name or column)   # a column without a name needs one


def text(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("string").alias(name or column)


def long(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("long").alias(name or column)
