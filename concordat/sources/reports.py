"""Reading written check rows back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.config import CHECKS_SCHEMA


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Check rows of every run below ``path``, as ``sinks.reports.write_checks`` left them."""
    return spark.read.schema(CHECKS_SCHEMA).json(path)
