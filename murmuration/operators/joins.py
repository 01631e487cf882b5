"""Joins of vectors by key, and concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.operators.attach import attach


def join_on_id(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Inner join of two vectors; ``id_col`` is unique in both."""
    return left.join(right, id_col)


def join_scalar(df: DataFrame, aggregate: Column, out: str) -> DataFrame:
    """A whole-table aggregate on every row, as a scalar subquery."""
    return df.withColumn(out, df.agg(aggregate).scalar())


def join_node_value(rows: DataFrame, node_values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A per-node value on every row of the node."""
    return attach(rows, node_values, keys)


def merge_by_max(
    left: DataFrame, right: DataFrame, columns: Sequence[str], id_col: str = "id"
) -> DataFrame:
    """Align two vectors of equal columns by key, keeping unmatched keys; where
    several rows share a key the largest value of each column wins.

    A union and an aggregate: one shuffle, after partial aggregation, where a
    full outer join would shuffle both sides whole.
    """
    both = union_all(left.select(id_col, *columns), right.select(id_col, *columns))
    return both.groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns])


def gather_by_index(
    df: DataFrame, value_col: str, index: Column, id_col: str = "id", out: str = "gathered", **limits: int
) -> DataFrame:
    """``out[i] = value[index(i)]``; rows whose index names no row get NULL.

    Any share of the rows may name one index: a vector too long to be broadcast is
    joined by shuffle but for the indices that many rows name, which are counted
    first (``attach``, which takes the ``limits``)."""
    values = df.select(F.col(id_col).cast("bigint").alias("_index"), F.col(value_col).alias(out))
    rows = df.withColumn("_index", index.cast("bigint"))
    return attach(rows, values.where(F.col("_index").isNotNull()), ["_index"], "left", **limits).drop("_index")


def rotated_index(
    id_col: str, shift: Column | int, size: Column | int, node: Column | int = 1
) -> Column:
    """``(shift + i - 1) mod size + 1`` inside a node of ``size`` keys."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    size = F.lit(size) if isinstance(size, int) else size
    node = F.lit(node) if isinstance(node, int) else node
    return F.pmod(shift + F.col(id_col) - F.lit(1), size) + F.lit(1) + (node - F.lit(1)) * size


def elementwise_combine(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, id_col: str = "id"
) -> DataFrame:
    """Product, sum and absolute difference of two vectors, key by key."""
    a, b = F.col(left_col), F.col(right_col)
    both = left.select(id_col, left_col).join(right.select(id_col, right_col), id_col)
    return both.select(
        id_col, (a * b).alias("product"), (a + b).alias("total"), F.abs(a - b).alias("abs_diff")
    )


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate vectors, keeping duplicates."""
    for other in others:
        first = first.unionByName(other)
    return first
