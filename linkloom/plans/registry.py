"""All queries of the core, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.temporal import found_times
from .queries import ORACLES, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p1_found": found_times} | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
