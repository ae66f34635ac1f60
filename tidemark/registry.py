"""Registered queries: name -> (Spark query, SQL that must give the same rows, or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.fixtures import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name; sql follows the views of the fixtures."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            starts = sql.strip()
            joined = "," + starts[4:] if views and starts[:5].upper() == "WITH " else starts
            ORACLE[f.__name__] = (VIEWS + joined) if views else starts
        return f

    return keep
