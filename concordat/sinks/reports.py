"""Check rows and step errors as JSON."""

from __future__ import annotations

import datetime as dt
import traceback

from pyspark.sql import DataFrame, SparkSession


def write_checks(checks: DataFrame, path: str) -> None:
    """Append the rows of a run; they are few, so one file per run and comparison set."""
    # A shuffle to one, as coalesce would run whatever plan is above in one task.
    checks.repartition(1).write.mode("append").json(path)


HEADER = (
    "run_id string, comparison string, source_label string, target_label string, started_at timestamp_ntz, "
    "duration_ms double, overall_status string, load_error string, summary string"
)


def header_path(path: str) -> str:
    return f"{str(path).rstrip('/')}.headers"


def write_headers(spark: SparkSession, headers: list[tuple], path: str) -> None:
    """One row for each comparison of a run, beside its check rows in ``path``."""
    spark.createDataFrame(headers, HEADER).repartition(1).write.mode("append").json(header_path(path))


ERROR_SCHEMA = "logged_at string, step string, error_type string, message string, statement string, traceback string"


def write_step_error(spark: SparkSession, path: str, step: str, statement: str, error: BaseException) -> None:
    row = (
        dt.datetime.now(dt.timezone.utc).isoformat(),
        step,
        type(error).__name__,
        str(error),
        statement,
        "".join(traceback.format_exception(error)),
    )
    spark.createDataFrame([row], ERROR_SCHEMA).coalesce(1).write.mode("append").json(path)
