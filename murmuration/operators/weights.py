"""Log-domain weights: normalisation, effective sample size, integer weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmuration.functions.slots import WEIGHT_BITS, quantize
from murmuration.operators.attach import attach


NOTHING = float("-inf")
#: Log-weights are added up relative to the multiple of this nearest to them.
BIN = 256.0


def number(column: str, otherwise: float | None) -> Column:
    """A weight or log-weight; ``otherwise`` where it is NaN or NULL. An infinite
    weight has no share that could be given to it, so it is refused."""
    value = F.col(column).cast("double")
    refused = F.raise_error(F.lit(f"{column} is infinite")).cast("double")
    missing = value.isNull() | F.isnan(value)
    return F.when(missing, F.lit(otherwise).cast("double")).when(value == F.lit(float("inf")), refused).otherwise(value)


def _with_peak(df: DataFrame, value: Column, group_cols: Sequence[str], n_groups: int | None) -> DataFrame:
    """The largest ``value`` on every row: a scalar subquery over the whole
    table, or the facts of each group."""
    if not group_cols:
        return df.withColumn("_peak", df.agg(F.max(value)).scalar())
    peaks = df.groupBy(*group_cols).agg(F.max(value).alias("_peak"))
    return attach(df, peaks, group_cols, n_facts=n_groups)


def weight_totals(df: DataFrame, log_weight_col: str = "lw", group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups, log_total, ess, rows), for the table or each group, in one scan.

    The largest log-weight need not be known first: weights are added up by the
    power of ``e^BIN`` nearest to them, each relative to that power, so nothing
    overflows, and partial sums merge as any sum does. What is left is a row for
    each power that occurs; those are related to the largest of the group. NaN and
    NULL count as no weight; where all do, ``log_total`` is ``-inf`` and the
    weights count as equal.
    """
    own = number(log_weight_col, NOTHING)
    place = F.when(own > F.lit(NOTHING), F.rint(own / F.lit(BIN)))
    rest = own - F.col("_place") * F.lit(BIN)
    bins = df.withColumn("_place", place).groupBy(*group_cols, "_place").agg(
        F.sum(F.exp(rest)).alias("_sum"),
        F.sum(F.exp(F.lit(2.0) * rest)).alias("_squares"),
        F.count(F.lit(1)).alias("_rows"),
    )
    bins = bins.withColumn("_top", F.max("_place").over(Window.partitionBy(*group_cols)))
    lower = (F.col("_place") - F.col("_top")) * F.lit(BIN)
    facts = bins.groupBy(*group_cols).agg(
        F.max("_top").alias("_top"),
        F.sum(F.col("_sum") * F.exp(lower)).alias("_sum"),
        F.sum(F.col("_squares") * F.exp(F.lit(2.0) * lower)).alias("_squares"),
        F.sum("_rows").alias("rows"),
    )
    known = F.col("_top").isNotNull()
    total = F.col("_top") * F.lit(BIN) + F.log("_sum")
    ess = F.col("_sum") * F.col("_sum") / F.col("_squares")
    return facts.select(
        *group_cols,
        F.when(known, total).otherwise(F.when(F.col("rows") > 0, F.lit(NOTHING))).alias("log_total"),
        F.when(known, ess).otherwise(F.col("rows").cast("double")).alias("ess"),
        "rows",
    )


def log_sum_exp(
    df: DataFrame, log_weight_col: str = "lw", group_cols: Sequence[str] = ()
) -> DataFrame:
    """The logarithm of the sum of ``exp(lw)``, for the table or for each group. NaN
    and NULL count as ``-inf``; where all do, so does the result."""
    return weight_totals(df, log_weight_col, group_cols).drop("ess", "rows")


def normalize_weights(
    df: DataFrame,
    log_weight_col: str = "lw",
    group_cols: Sequence[str] = (),
    out: str = "lw",
    n_groups: int | None = None,
) -> DataFrame:
    """Shift log-weights so that ``sum(exp(out)) = 1``, for the table or each group.
    NaN and NULL count as ``-inf``; where all do, the weights become equal."""
    nothing = F.col("log_total") == F.lit(NOTHING)
    # what takes the place of the total, worked out once for the table or group
    facts = F.struct(
        F.when(~nothing, F.col("log_total")).alias("total"), (-F.log(F.col("rows").cast("double"))).alias("equal")
    )
    total = weight_totals(df, log_weight_col, group_cols).select(*group_cols, facts.alias("_facts"))
    both = attach(df, total, group_cols, n_facts=n_groups) if group_cols else df.withColumn("_facts", total.scalar())
    own = F.nanvl(F.col(log_weight_col).cast("double"), F.lit(NOTHING))  # the totals have refused infinite ones
    shifted = F.coalesce(own, F.lit(NOTHING)) - F.col("_facts.total")
    return both.withColumn(out, F.coalesce(shifted, F.col("_facts.equal"))).drop("_facts")


def effective_sample_size(df: DataFrame, log_weight_col: str = "lw", group_cols: Sequence[str] = ()) -> DataFrame:
    """``1 / sum(exp(lw)^2)`` of normalised log-weights; ``weight_totals`` has it for any."""
    return df.groupBy(*group_cols).agg((F.lit(1.0) / F.sum(F.exp(F.lit(2.0) * F.col(log_weight_col)))).alias("ess"))


def integer_weights(
    df: DataFrame,
    weight_col: str,
    group_cols: Sequence[str] = (),
    out: str = "wq",
    log: bool = False,
    bits: int = WEIGHT_BITS,
    n_groups: int | None = None,
    draw: Column | None = None,
) -> DataFrame:
    """Weights (or log-weights) as integers relative to the heaviest of the group;
    those that are not numbers become zero, infinite ones are refused. They are
    rounded to the nearest, or, given a uniform ``draw`` for each row, up with the
    probability of what rounding down would lose.

    Each depends on its own row and that maximum only, not on a floating-point
    sum, so the result does not change with the partitioning.
    """
    own, peak = number(weight_col, None), F.col("_peak")
    peaked = _with_peak(df, own, group_cols, n_groups)
    relative = F.exp(own - peak) if log else own / F.nullif(peak, F.lit(0.0))
    return peaked.withColumn(out, quantize(relative, bits, draw)).drop("_peak")
