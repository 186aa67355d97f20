"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with its SQL where there is any."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


from . import model_queries, more_queries, panel_queries, response_queries, scoring_queries  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["score_naive_global"](spark, sf_dir)
