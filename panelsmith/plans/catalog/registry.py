"""Registered queries: a Spark function over (session, table folder), and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def rounded_sql(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + CAST(0 AS DOUBLE)"


def round_columns(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})
