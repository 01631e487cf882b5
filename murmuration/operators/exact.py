"""Sums of doubles that do not depend on how the rows are partitioned.

Doubles are dealt to bins of 16 powers of two. Inside a bin every value is an
integer multiple of one quantum, and is cut into four limbs of at most 18 bits,
which are added up as BIGINT: exact, mergeable, and with room for 2^45 rows. So one
scan with partial aggregation gives a handful of rows per group; they are turned into
doubles bin by bin, each rounded once, and added from the largest bin downwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STEP = 16
#: Bits of the limbs after the point; before it are ``STEP``.
LIMBS = (18, 18, 16)


def _scaled(x: Column, power: Column) -> Column:
    """``x * 2^(STEP * power)``, in two factors, as one alone may overflow."""
    half = F.pow(F.lit(2.0), F.lit(STEP // 2) * power)
    return x * half * half


def _bin(size: Column) -> Column:
    """The bin of a finite size above zero; the logarithm may be off by an ulp."""
    guess = F.floor(F.log2(size) / F.lit(STEP))
    seen = _scaled(size, -guess)
    above, below = seen >= F.lit(float(1 << STEP)), seen < F.lit(1.0)
    return guess + F.when(above, 1).when(below, -1).otherwise(0)


def exact_sums(df: DataFrame, values: dict[str, Column], group_cols: Sequence[str] = ()) -> DataFrame:
    """One DOUBLE sum for each of ``values``, per group: equal to the last bit for any
    partitioning and order of rows.

    NULLs are left out; without any value the sum is NULL. Values that cancel out
    leave what is left exactly. NaN and infinite values give what ``SUM`` gives. A
    table without rows gives one row of NULLs when there are no groups. Names with a
    leading ``_s_`` are reserved."""
    if any(c.startswith("_s_") for c in group_cols):
        raise ValueError("names that begin with _s_ are reserved")
    each = F.array(*[F.struct(F.lit(k).alias("_s_k"), v.cast("double").alias("_s_x")) for k, v in enumerate(values.values())])
    rows = df.select(*group_cols, F.inline(each))
    x = F.col("_s_x")
    odd = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    size = F.when(~odd, F.abs(x))
    rows = rows.withColumn("_s_bin", F.when(size > 0, _bin(size)).otherwise(F.lit(0)).cast("int"))
    rest, sign, limbs = _scaled(size, -F.col("_s_bin")), F.signum(F.when(~odd, x)).cast("bigint"), []
    for bits in (*LIMBS, None):
        whole = F.floor(rest)
        limbs.append(F.sum(sign * whole).alias(f"_s_{len(limbs)}"))
        if bits is not None:
            rest = (rest - whole) * F.lit(float(1 << bits))
    parts = rows.groupBy(*group_cols, "_s_k", "_s_bin").agg(*limbs, F.sum(F.when(odd, x)).alias("_s_odd"))

    units = F.col("_s_0").cast("decimal(38,0)")
    for k, bits in enumerate(LIMBS):
        units = (units * F.lit(1 << bits) + F.col(f"_s_{k + 1}")).cast("decimal(38,0)")
    value = _scaled(units.cast("double") * F.lit(2.0 ** -sum(LIMBS)), F.col("_s_bin"))
    parts = parts.select(*group_cols, "_s_k", "_s_bin", value.alias("_s_x"), "_s_odd")
    outs = []
    for k, name in enumerate(values):
        own = (F.col("_s_k") == F.lit(k)) & F.col("_s_x").isNotNull()
        found = F.sort_array(F.collect_list(F.when(own, F.struct("_s_bin", "_s_x"))), asc=False)
        total = F.aggregate(found, F.lit(0.0), lambda s, p: s + p["_s_x"])
        special = F.sum(F.when(F.col("_s_k") == F.lit(k), F.col("_s_odd")))
        outs.append(F.coalesce(special, F.when(F.size(found) > 0, total)).alias(name))
    return parts.groupBy(*group_cols).agg(*outs)
