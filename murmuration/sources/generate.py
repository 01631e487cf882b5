"""Generated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def id_range(spark: SparkSession, n: int, id_col: str = "id") -> DataFrame:
    """Keys ``1 .. n``."""
    return spark.range(1, n + 1).withColumnRenamed("id", id_col)
