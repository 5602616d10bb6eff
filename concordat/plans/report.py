"""Check rows, and the statuses and summaries rolled up from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.config import CHECKS_SCHEMA, FAILED, PASSED, SKIPPED, Comparison


@dataclass
class Check:
    layer: str
    name: str
    status: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    duration_ms: float = 0.0
    skipped_reason: str = ""


def verdict(layer: str, name: str, ok: bool, good: str, bad: str, details: dict | None = None, ms: float = 0.0) -> Check:
    return Check(layer, name, PASSED if ok else FAILED, good if ok else bad, details or {}, ms)


def skipped(layer: str, name: str, message: str, to_enable: str) -> Check:
    return Check(layer, name, SKIPPED, message, skipped_reason=to_enable)


def as_rows(checks: list[Check], cfg: Comparison, run_id: str) -> list[tuple]:
    """Checks in the order of ``CHECKS_SCHEMA``."""
    return [
        (
            run_id,
            cfg.name,
            c.layer,
            c.name,
            c.status,
            c.message,
            json.dumps(c.details, default=str),
            float(c.duration_ms),
            c.skipped_reason,
        )
        for c in checks
    ]


def checks_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CHECKS_SCHEMA)


def layer_status(checks: DataFrame) -> DataFrame:
    """(run_id, comparison, layer, status): one failed check fails its layer, a skipped one
    never does."""
    failed = F.bool_or(F.col("status") == FAILED)
    return checks.groupBy("run_id", "comparison", "layer").agg(F.when(failed, FAILED).otherwise(PASSED).alias("status"))


def overall_status(checks: DataFrame) -> DataFrame:
    """(run_id, comparison, status)."""
    failed = F.bool_or(F.col("status") == FAILED)
    return layer_status(checks).groupBy("run_id", "comparison").agg(F.when(failed, FAILED).otherwise(PASSED).alias("status"))


def summarise(checks: DataFrame) -> DataFrame:
    """One row per comparison: counts, pass rate, whether the tables are equivalent, the
    failures and the skipped checks with what would enable them."""
    is_ = lambda status: F.col("status") == status
    listed = lambda status, *cols: F.sort_array(F.collect_list(F.when(is_(status), F.struct(*cols))))
    counts = checks.groupBy("run_id", "comparison").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(is_(PASSED)).alias("passed"),
        F.count_if(is_(FAILED)).alias("failed"),
        F.count_if(is_(SKIPPED)).alias("skipped"),
        listed(FAILED, "layer", "check_name", "message").alias("failures"),
        listed(SKIPPED, "layer", "check_name", "message", F.col("skipped_reason").alias("to_enable")).alias(
            "skipped_checks"
        ),
    )
    ran = F.greatest(F.col("total_checks") - F.col("skipped"), F.lit(1))
    layers = layer_status(checks).groupBy("run_id", "comparison").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "status")))).alias("layer_statuses")
    )
    return (
        counts.join(layers, ["run_id", "comparison"])
        .withColumn("pass_rate", F.round(F.col("passed") / ran, 4))
        .withColumn("equivalent", F.col("failed") == 0)
    )
