"""Names of all queries of the library, without those of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkreg.jobs import columns, datasets, models, robust

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (datasets, columns, models, robust)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
