"""Queries over the star-schema tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is its oracle."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return _QUERIES


def oracle_sql():
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["resolve_prefer_weight"](spark, sf_dir)


from claimforge.plans import duplicates, entities, golden, operations, records, replies, reports, rules, store, streams, texts  # noqa: E402,F401
