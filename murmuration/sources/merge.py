"""Several differently shaped inputs as one vector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.operators.joins import union_all


def merge_sources(inputs: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Map each named input to common columns and concatenate them, with the
    input's name as ``source``."""
    shaped = [
        df.select(F.lit(name).alias("source"), *[c.alias(out) for out, c in columns.items()])
        for name, (df, columns) in inputs.items()
    ]
    return union_all(*shaped)
