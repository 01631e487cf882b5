"""Integer weights and the slot arithmetic of systematic resampling.

Weights are integers and every product is DECIMAL(38, 0), so running totals do
not depend on the order of summation, copies add up to exactly ``n``, and an
overflow raises instead of wrapping. With 40-bit weights there is room for
2^43 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEIGHT_BITS = 40
WIDE = "decimal(38,0)"
ONE_32 = 2**32
# Bound on the relative error of a few double operations, with a wide margin.
ROUNDING = 2.0**-46


def wide(value: Column) -> Column:
    return value.cast(WIDE)


def integer_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def floor_div(value: Column, size: int) -> Column:
    """Integer division that rounds down for negative values too."""
    by = F.lit(size).cast("bigint")
    return integer_div(value - F.pmod(value, by), by).cast("bigint")


def quantize(relative_weight: Column, bits: int = WEIGHT_BITS, draw: Column | None = None) -> Column:
    """A weight in [0, 1] (relative to the heaviest) as an integer; a weight
    that is not a number counts as zero.

    To the nearest integer, weights below half of ``2^-bits`` vanish, which robs a
    very large number of light rows of their share. With a uniform ``draw`` in
    [0, 1), keyed by the row, every weight keeps its value on average.
    """
    up = F.lit(0.5) if draw is None else draw
    scaled = F.floor(relative_weight * F.lit(float(2**bits)) + up)
    return F.when(relative_weight.isNull() | F.isnan(relative_weight), F.lit(0)).otherwise(scaled).cast("bigint")


def offset_bits(u: float) -> int:
    """A uniform offset in [0, 1) as a 32-bit integer."""
    if not 0.0 <= u < 1.0:
        raise ValueError("the offset must lie in [0, 1)")
    return int(u * ONE_32)


def offset_shift(total: Column, u_bits: Column) -> Column:
    """``floor(total * u)`` with ``u = u_bits / 2^32``, one value per group.

    ``div`` returns a BIGINT, so the total is split at 2^32 to keep each
    quotient small.
    """
    by = F.lit(ONE_32).cast(WIDE)
    upper = integer_div(wide(total), by)
    lower = wide(total) - wide(upper) * by
    return wide(wide(u_bits) * wide(upper) + wide(integer_div(wide(u_bits) * wide(lower), by)))


def slot_end(cumulative: Column, total: Column, n: Column, shift: Column) -> Column:
    """``floor(n * cumulative / total + u)``, exactly, given ``shift = floor(total * u)``.

    ``n * cumulative`` is an integer, so rounding ``total * u`` down first does
    not change the result, and the product stays below 2^126. A result that
    does not fit fails the job even where ANSI mode is off.
    """
    slot = integer_div(wide(wide(cumulative) * wide(n)) + wide(shift), wide(total))
    return F.coalesce(slot, F.raise_error(F.lit("weights times rows exceed 38 digits")).cast("bigint"))


def slot_within(local: Column, base: Column, head: Column, rate: Column, exact: Column) -> Column:
    """The slot of a row by its running sum inside a cell.

    The cell starts at slot ``base + head`` with ``0 <= head < 1``, and each
    unit of weight is ``rate`` slots. The double decides unless it comes so
    near to a whole number that its rounding could matter; then ``exact``, the
    number of whole slots since ``base`` in integer arithmetic, does.
    """
    inside = head + local.cast("double") * rate
    whole = F.floor(inside)
    part = inside - whole.cast("double")
    doubt = (inside + F.lit(1.0)) * F.lit(ROUNDING)
    return base + F.when((part > doubt) & (part < F.lit(1.0) - doubt), whole).otherwise(exact)


def effective_size(total: Column, squares: Column, rows: Column) -> Column:
    """``(sum w)^2 / sum w^2`` of integer weights; equal weights where all are zero."""
    whole = total.cast("double")
    return F.when(total == F.lit(0), rows.cast("double")).otherwise(whole * whole / squares.cast("double"))


def quantize_offset(cumulative: Column, total: Column, n: Column, u_bits: Column) -> Column:
    """Cumulative weight to integer slot."""
    return slot_end(cumulative, total, n, offset_shift(total, u_bits))


def node_of(key: Column, size: int) -> Column:
    """1-based group of ``size`` consecutive 1-based keys."""
    return floor_div(key - F.lit(1), size) + F.lit(1)


def position_in_node(key: Column, size: int) -> Column:
    """0-based place of a 1-based key in its group."""
    return F.pmod(key - F.lit(1), F.lit(size))
