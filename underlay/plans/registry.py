"""Every query of the engine, by name, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as records

FLAGSHIP = "char_zero_width"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.QUERIES[FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(records.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(records.ORACLE)
