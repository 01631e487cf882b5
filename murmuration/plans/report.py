"""Per-step results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

STEP_REPORT_SCHEMA = "step INT, z DOUBLE, ess DOUBLE, resampled BOOLEAN, estimate DOUBLE"


def step_report(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """One row per step; the number of steps is bounded by the filter loop."""
    return spark.createDataFrame(list(rows), STEP_REPORT_SCHEMA)
