"""Vectors as ``key,value`` text lines, or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The line format is an integer key, a comma and a number.
KEYVALUE_SCHEMA = "id BIGINT, x DOUBLE"


def read_keyvalue(spark: SparkSession, path: str, schema: str = KEYVALUE_SCHEMA) -> DataFrame:
    """Read ``key,value`` lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def read_vector(spark: SparkSession, path: str, schema: str = KEYVALUE_SCHEMA) -> DataFrame:
    """The columns of ``schema`` from Parquet, cast to its types; others are not read."""
    wanted = [part.split() for part in schema.split(",")]
    return spark.read.parquet(path).select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def write_keyvalue(df: DataFrame, path: str, id_col: str = "id", value_col: str = "x") -> None:
    """Write a vector as ``key,value`` lines into a new folder."""
    df.select(id_col, value_col).write.mode("errorifexists").csv(path)
