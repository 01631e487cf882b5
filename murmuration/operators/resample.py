"""Systematic (minimum variance) resampling.

Each row gets the half-open range of output slots ``slot_lo .. slot_hi`` its
weight covers; the copies are the slots in that range and the slot numbers are
the new ids, so no renumbering follows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmuration.functions.slots import (
    WEIGHT_BITS,
    WIDE,
    effective_size,
    floor_div,
    offset_bits,
    offset_shift,
    quantize_offset,
    slot_end,
    slot_within,
    wide,
)
from murmuration.operators.scan import BUCKET, Cells, cell_sums, join_cells, lay_out, prefix_sum, scan, written_once
from murmuration.operators.weights import integer_weights
from murmuration.plans.stage import shuffle_partitions

CHUNK = 2**16


def _bits(offset: float | Column) -> Column:
    return F.lit(offset_bits(offset)) if isinstance(offset, (int, float)) else offset


def _own(weight_col: str) -> Column:
    own = F.coalesce(F.col(weight_col), F.lit(0)).cast("bigint")
    return F.when(own < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(own)


def _fits(cells: Cells, weight_bits: int | None) -> bool:
    """Whether sums of the weights of a cell fit a BIGINT."""
    return (
        weight_bits is not None
        and cells.most_rows is not None
        and weight_bits + cells.most_rows.bit_length() <= 61
    )


def weight_sums(
    cells: Cells, weight_col: str, weight_bits: int | None = None, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per cell: the number of ``rows``, the sum ``w`` of its weights, the sum
    of their ``squares``, exactly, and ``extra`` sums.

    Where a cell's sums fit, they are added up as BIGINT, squares in the parts
    of ``(a 2^h + b)^2``, and widened once per cell.
    """
    own, extra = _own(weight_col), extra or {}
    rows = F.lit(1).cast("bigint")
    if not _fits(cells, weight_bits):
        return cell_sums(cells, {"rows": rows, "w": wide(own), "squares": wide(own) * wide(own), **extra})
    half = weight_bits // 2
    upper, lower = F.shiftright(own, half), own.bitwiseAND(F.lit(2**half - 1))
    parts = {"_aa": upper * upper, "_ab": upper * lower, "_bb": lower * lower}
    sums = cell_sums(cells, {"rows": rows, "_w": own, **parts, **extra})

    def scaled(part: str, power: int) -> Column:
        return wide(wide(F.col(part)) * F.lit(2**power).cast(WIDE))

    squares = wide(scaled("_aa", 2 * half) + scaled("_ab", half + 1) + wide(F.col("_bb")))
    return sums.withColumns({"w": wide(F.col("_w")), "squares": squares}).drop("_w", *parts)


def slots_of(
    cells: Cells,
    weight_col: str,
    n: int | None,
    offset: float | Column,
    id_col: str,
    keep_above: float | None = None,
    weight_bits: int | None = None,
    dense_ids: bool = False,
    sums: DataFrame | None = None,
) -> DataFrame:
    """Slots of integer weights. Equal weights stand in where all are zero.

    With ``keep_above`` a group whose effective sample size exceeds that
    fraction of its rows is not resampled: each row keeps one slot.
    ``weight_bits`` promises weights up to ``2^weight_bits``, so that sums
    inside a cell of bounded size may be BIGINT where they fit.
    ``dense_ids`` promises ids that count from 1 in each group. ``sums`` is
    the result of ``weight_sums`` where the caller has kept it.
    """
    own, one = _own(weight_col), F.lit(1).cast("bigint")
    if sums is None:
        sums = weight_sums(cells, weight_col, weight_bits)
    running = {"w": own if _fits(cells, weight_bits) else wide(own)}
    if not dense_ids:
        running["rows"] = one

    def derive(table: DataFrame) -> DataFrame:
        rows, weight, total = F.col("group_rows"), F.col("group_w"), F.col("_total")
        size = rows if n is None else F.lit(n).cast("bigint")
        table = table.withColumns({"total_w": weight, "_flat": weight == F.lit(0), "_size": size})
        table = table.withColumn("_total", F.when(F.col("_flat"), wide(rows)).otherwise(weight))
        table = table.withColumn("_shift", offset_shift(total, _bits(offset)))
        table = table.withColumn("_base", slot_end(F.col("before_w"), total, F.col("_size"), F.col("_shift")))
        rest = wide(wide(F.col("before_w")) * wide(F.col("_size"))) + F.col("_shift")
        table = table.withColumn("_rest", wide(rest - wide(wide(F.col("_base")) * total)))
        table = table.withColumns(
            {
                "_head": F.col("_rest").cast("double") / total.cast("double"),
                "_rate": F.col("_size").cast("double") / total.cast("double"),
            }
        )
        if keep_above is not None:
            table = table.withColumn("ess", effective_size(weight, F.col("group_squares"), rows))
            table = table.withColumn("resampled", F.col("ess") <= F.lit(keep_above) * rows)
        return table

    facts = ["total_w", "_flat", "_size", "_total", "_shift", "_base", "_rest", "_head", "_rate"]
    totals = ["w", "rows"]
    if keep_above is not None:
        facts += ["ess", "resampled"]
        totals.append("squares")
    if not dense_ids:
        facts.append("before_rows")
    rows = join_cells(cells, [id_col], running, sums, totals, derive, facts)

    place = F.col(id_col) if dense_ids else F.col("local_rows") + F.col("before_rows")
    total, size = F.col("_total"), F.col("_size")

    def slot(local: Column, position: Column) -> Column:
        exact = slot_end(local, total, size, F.col("_rest"))
        inside = slot_within(local, F.col("_base"), F.col("_head"), F.col("_rate"), exact)
        even = slot_end(position, total, size, F.col("_shift"))
        found = F.when(F.col("_flat"), even).otherwise(inside)
        if keep_above is None:
            return found
        return F.when(F.col("resampled"), found).otherwise(position)

    local = F.col("local_w")
    out = rows.withColumns({"slot_lo": slot(local - own, place - one), "slot_hi": slot(local, place)})
    out = out.withColumn("n_copies", F.col("slot_hi") - F.col("slot_lo"))
    kept = ["total_w", "ess", "resampled"] if keep_above is not None else ["total_w"]
    return out.select(*cells.rows.columns, *kept, "slot_lo", "slot_hi", "n_copies")


def _refuse(df: DataFrame, *names: str) -> None:
    """Columns that an operator makes must not be there already."""
    if taken := sorted(set(names) & set(df.columns)):
        raise ValueError(f"the input already has the columns {taken}")


def cumulative_slots(
    df: DataFrame, weight_col: str = "wq", offset: float = 0.0, id_col: str = "id", n: int | None = None
) -> DataFrame:
    """(id, slot): the slot in which each row's cumulative weight ends, of ``n``
    slots, or as many as rows. Rows are written once; their number, total and key
    range come from that pass."""
    rows = df.select(id_col, weight_col)
    rows, layout, width, facts = written_once(rows, id_col, total=F.sum(weight_col), rows=F.count(F.lit(1)))
    summed = prefix_sum(rows, weight_col, id_col, "_c", layout=layout, width=width)
    total, size = F.lit(facts["total"]), F.lit(n or facts["rows"])
    return summed.select(id_col, quantize_offset(F.col("_c"), total, size, _bits(offset)).alias("slot"))


def systematic_copies(
    df: DataFrame,
    weight_col: str = "wq",
    n: int | None = None,
    offset: float | Column = 0.0,
    id_col: str = "id",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    bits: int = WEIGHT_BITS,
    draw: Column | None = None,
) -> DataFrame:
    """Copies per row: within one of ``n w / sum(w)``, adding up to exactly ``n``.

    ``n`` defaults to the number of rows of the table (or group). ``offset`` is
    a number in [0, 1), or a column of 32-bit integers over the group columns.
    Floating-point weights are made integers first; ``draw`` is a uniform number
    for each row that decides whether its weight is rounded up.
    """
    _refuse(df, "total_w", "slot_lo", "slot_hi", "n_copies", "_wq")
    if isinstance(df.schema[weight_col].dataType, (T.DoubleType, T.FloatType)):
        weighted = integer_weights(df, weight_col, group_cols, out="_wq", bits=bits, draw=draw)
        cells = lay_out(weighted, [id_col], group_cols, layout)
        return cells.drop_keys(slots_of(cells, "_wq", n, offset, id_col, weight_bits=bits)).drop("_wq")
    cells = lay_out(df, [id_col], group_cols, layout)
    weight_bits = None
    if cells.most_rows is not None:
        # One narrow pass that usually allows BIGINT sums inside the cells.
        weight_bits = int(df.agg(F.max(weight_col)).first()[0] or 0).bit_length()
    return cells.drop_keys(slots_of(cells, weight_col, n, offset, id_col, weight_bits=weight_bits))


def cut_ranges(df: DataFrame, low: Column, high: Column, width: int, out: str) -> DataFrame:
    """One row for each multiple of ``width`` that a range ``low+1 .. high`` falls
    into, numbered in ``out``; none for an empty range. Ranges are first cut at
    the square of ``width``, so that no array has more than ``width`` entries
    unless a range holds more than the cube of it."""
    outer = width * width
    # A condition inside explode, not a filter: a filter would be pushed below
    # the columns it reads and evaluate the slot arithmetic a second time.
    last = high - F.lit(1)
    wide = F.when(high > low, F.sequence(floor_div(low, outer), floor_div(last, outer)))
    by = F.lit(outer).cast("bigint")
    first_in = F.greatest(low, F.col("_outer") * by)
    last_in = F.least(last, (F.col("_outer") + F.lit(1)) * by - F.lit(1))
    cut = df.withColumn("_outer", F.explode(wide))
    return cut.withColumn(out, F.explode(F.sequence(floor_div(first_in, width), floor_div(last_in, width)))).drop("_outer")


def expand_slots(
    df: DataFrame,
    lo: str = "slot_lo",
    hi: str = "slot_hi",
    out: str = "id",
    group_cols: Sequence[str] = (),
    width: int = CHUNK,
    bucket: str | None = None,
) -> DataFrame:
    """One row for each slot ``lo+1 .. hi``, evenly spread over the tasks.

    Ranges are cut at multiples of ``width`` and the pieces are shuffled by the
    interval they fall into before they are expanded. An interval yields at
    most ``width`` rows per group, whether they come from one source row or
    from many. The number of partitions is explicit, because adaptive
    coalescing would judge the pieces by their size before expansion. With
    ``bucket`` the interval number stays as a column: the dense bucket of the
    new ids, already partitioned for the next scan.
    """
    piece = bucket or BUCKET
    step = F.lit(width).cast("bigint")
    low, high = F.col(lo), F.col(hi)
    pieces = cut_ranges(df, low, high, width, piece)
    spread = pieces.repartition(shuffle_partitions(df), *group_cols, piece)
    first = F.greatest(low, F.col(piece) * step) + F.lit(1)
    last = F.least(high, (F.col(piece) + F.lit(1)) * step)
    grown = spread.withColumn("_slot", F.explode(F.sequence(first, last))).drop(lo, hi)
    grown = grown.withColumn(out, F.col("_slot")).drop("_slot")
    return grown if bucket else grown.drop(piece)


def replicate_by_count(
    df: DataFrame,
    count_col: str = "n_copies",
    id_col: str = "id",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    width: int = CHUNK,
) -> DataFrame:
    """Repeat each row ``count_col`` times; copies get dense new ids in the
    order of (source id, copy number) and keep the source id as ``src``."""
    width_of_cells = None
    if layout == "auto" and not group_cols and isinstance(df.schema[id_col].dataType, T.IntegralType):
        df, layout, width_of_cells, _ = written_once(df, id_col)
    cells = lay_out(df, [id_col], group_cols, layout, width_of_cells)
    summed = cells.drop_keys(scan(cells, [id_col], {"slot_hi": F.col(count_col).cast("bigint")}))
    ranged = summed.withColumn("slot_lo", F.col("slot_hi") - F.col(count_col))
    return replicate_balanced(ranged, id_col, group_cols, width)


def replicate_balanced(
    df: DataFrame,
    id_col: str = "id",
    group_cols: Sequence[str] = (),
    width: int = CHUNK,
    bucket: str | None = None,
) -> DataFrame:
    """Repeat rows that already carry ``slot_lo`` and ``slot_hi``; the work per
    task does not depend on how the copies are shared out among the rows."""
    renamed = df.withColumnRenamed(id_col, "src")
    return expand_slots(renamed, out=id_col, group_cols=group_cols, width=width, bucket=bucket)


def resample(
    df: DataFrame,
    weight_col: str = "wq",
    n: int | None = None,
    offset: float | Column = 0.0,
    id_col: str = "id",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    width: int = CHUNK,
) -> DataFrame:
    """Weights in, equally weighted rows out, with new ids and ``src``."""
    _refuse(df, "src")
    copies = systematic_copies(df, weight_col, n, offset, id_col, group_cols, layout)
    narrowed = copies.drop(weight_col, "total_w", "n_copies")
    return replicate_balanced(narrowed, id_col, group_cols, width)


def resample_if_needed(
    df: DataFrame,
    weight_col: str = "wq",
    fraction: float = 0.5,
    offset: float | Column = 0.0,
    id_col: str = "id",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    width: int = CHUNK,
    bucket: str | None = None,
) -> DataFrame:
    """Resample a table, or those of its groups, whose effective sample size is
    at most ``fraction`` of its rows; other rows pass through, once each.

    The decision is a column of the same plan, so groups may differ and no
    value travels through the driver.
    """
    _refuse(df, "src", "total_w", "ess", "resampled", "slot_lo", "slot_hi", "n_copies")
    cells = lay_out(df, [id_col], group_cols, layout)
    copies = slots_of(cells, weight_col, None, offset, id_col, keep_above=fraction)
    narrowed = cells.drop_keys(copies).drop(weight_col, "total_w", "n_copies")
    if bucket and layout == "carried":
        narrowed = narrowed.drop(BUCKET)
    return replicate_balanced(narrowed, id_col, group_cols, width, bucket)
