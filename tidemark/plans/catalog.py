"""Registered queries of the bar engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.plans import indicator_queries, trading_queries


def flagship(spark, sf_dir: str) -> DataFrame:
    return indicator_queries.window_plan(spark, sf_dir)


def queries() -> dict[str, Callable]:
    return indicator_queries.queries() | trading_queries.queries()


def oracle_sql() -> dict[str, str]:
    return indicator_queries.oracle_sql() | trading_queries.oracle_sql()
