"""Where the engine's queries are registered, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Added before rounding, so that no value lies on the tie of six decimals, where engines round apart.
NUDGE = 3.3333e-8


def query(name: str, sql: str | None = None):
    """Register a query; sql is what DuckDB runs on the same tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(_views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def _views(spark: SparkSession, sf_dir: str):
    from .sources.views import Views

    return Views(spark, sf_dir)


def r6(c: Column | str) -> Column:
    """A double to six decimals, alike in Spark and DuckDB. Multiplied and divided as DuckDB does it: F.round goes through a decimal for
    each value, which costs more than most descriptors."""
    return F.rint(((F.col(c) if isinstance(c, str) else c).cast("double") + F.lit(NUDGE)) * 1e6) / 1e6 + 0.0


def r9(c: Column | str) -> Column:
    """A double of at least 0 to nine decimals, halves up, as DuckDB's round has it and without a decimal for each value."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e9 + 0.5) / 1e9


def sql_r6(expression: str) -> str:
    return f"round(cast({expression} AS double) + {NUDGE}, 6)"
