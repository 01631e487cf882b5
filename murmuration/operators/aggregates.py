"""Global and per-group aggregates; partial aggregation runs before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.operators.exact import exact_sums


def max_weight(df: DataFrame, weight_col: str = "lw", group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.max(weight_col).alias("max_w"))


def tree_sum(
    df: DataFrame, value_col: str, group_cols: Sequence[str] = (), out: str = "total", reproducible: bool = False
) -> DataFrame:
    """The sum of each group; ``reproducible``: a DOUBLE that does not depend on
    partitioning (``exact_sums``)."""
    if reproducible:
        return exact_sums(df, {out: F.col(value_col)}, group_cols)
    return df.groupBy(*group_cols).agg(F.sum(value_col).alias(out))


def weighted_mean(
    df: DataFrame,
    weight_col: str = "w",
    value_col: str = "x",
    group_cols: Sequence[str] = (),
    reproducible: bool = False,
) -> DataFrame:
    """``sum(w x) / sum(w)``; NULL where the weights add up to zero. ``reproducible``
    as for ``tree_sum``."""
    if reproducible:
        both = {"_moment": F.col(weight_col) * F.col(value_col), "_total": F.col(weight_col)}
        estimate = F.col("_moment") / F.nullif(F.col("_total"), F.lit(0.0))
        return exact_sums(df, both, group_cols).select(*group_cols, estimate.alias("estimate"))
    total = F.sum(weight_col)
    moment = F.sum(F.col(weight_col) * F.col(value_col))
    return df.groupBy(*group_cols).agg((moment / F.nullif(total, F.lit(0))).alias("estimate"))


def posterior_mean(
    df: DataFrame, value_col: str = "x", group_cols: Sequence[str] = (), reproducible: bool = False
) -> DataFrame:
    """Plain mean of an equally weighted population; ``reproducible`` as for ``tree_sum``."""
    if reproducible:
        one = F.when(F.col(value_col).isNotNull(), F.lit(1.0))
        sums = exact_sums(df, {"_sum": F.col(value_col), "_rows": one}, group_cols)
        return sums.select(*group_cols, (F.col("_sum") / F.col("_rows")).alias("estimate"))
    return df.groupBy(*group_cols).agg(F.avg(value_col).alias("estimate"))


def group_max_key(
    df: DataFrame, node: str | Column, id_col: str = "id", size: int | None = None
) -> DataFrame:
    """Largest key of each node and, given the node size, the slot before its first."""
    node_col = F.col(node) if isinstance(node, str) else node
    out = df.groupBy(node_col.alias("node")).agg(F.max(id_col).alias("max_id"))
    return out if size is None else out.withColumn("before_first", F.col("max_id") - F.lit(size))


def count_rows(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"))


def conditional_count(df: DataFrame, conditions: dict[str, Column], group_cols: Sequence[str] = ()) -> DataFrame:
    """How many rows meet each condition."""
    return df.groupBy(*group_cols).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
