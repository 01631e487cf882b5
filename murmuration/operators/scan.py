"""Running sums and lags over a whole table, or over each group of it.

An un-partitioned window would put every row in one task, and a window
partitioned by group would do so for a group that holds a third of the rows.
Here rows are laid out in *cells*, (group, bucket) pairs of bounded size that
follow the order of the rows. A window runs inside each cell; a table with one
row per cell supplies what came before it. That table is joined on the key the
window has already partitioned by, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from murmuration.functions.slots import floor_div
from murmuration.plans.stage import materialize, materialize_observed, shuffle_partitions

MAX_BUCKETS = 2**20
MIN_WIDTH = 2**12
MAX_WIDTH = 2**20

BUCKET = "_bucket"

#: Quantiles of one group at most, and how many are compared with a row at a time.
MOST_BOUNDS = 2**10
STRIDE = 2**5


def bucket_width(n: int, partitions: int) -> int:
    """Rows per bucket for ``n`` consecutive keys: about eight buckets per
    partition, at most ``MAX_WIDTH`` rows each until that would make more than
    ``MAX_BUCKETS`` of them."""
    even = -(-n // (8 * partitions))
    return max(min(max(even, MIN_WIDTH), MAX_WIDTH), -(-n // MAX_BUCKETS), 1)


@dataclass(frozen=True)
class Cells:
    """Rows with their cell key: ``keys`` are non-null columns of ``rows``.
    ``most_rows`` bounds the rows of a cell where the layout gives a bound."""

    rows: DataFrame
    keys: tuple[str, ...]
    group_cols: tuple[str, ...]
    group_keys: tuple[str, ...]
    added: tuple[str, ...]
    most_rows: int | None

    def drop_keys(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.added)


def lay_out(
    df: DataFrame,
    order: Sequence[str | Column],
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    width: int | None = None,
) -> Cells:
    """Assign every row to a cell.

    ``dense``: one integer order column, unique within a group; cells are
    intervals of ``width`` keys, so none holds more than ``width`` rows.
    ``range``: any order columns; cells follow sampled quantiles of
    (group, order), so a hot group is split and small groups share a bucket.
    The sample is fixed by materialising the rows.
    ``sketched``: one order column that has quantiles. Groups are counted; the few
    that hold more than a task's share are cut at quantiles from a mergeable
    sketch, and the cell of a row follows from its own key, so the rows need
    neither be written nor moved for it. Equal keys share a cell.
    ``carried``: the rows already have a bucket column, over intervals of
    ``width`` keys.
    ``auto``: dense for an ungrouped integer key whose span allows it, else
    sketched where the order column allows it, else range.
    """
    if layout == "auto":
        layout, width = _choose(df, order, group_cols, width)
    keyed, group_keys = non_null_keys(df, group_cols)
    stand_ins = tuple(k for k in group_keys if k not in group_cols)
    if layout == "dense":
        (key,) = order
        width = width or MAX_WIDTH
        key = F.col(key) if isinstance(key, str) else key
        rows = keyed.withColumn(BUCKET, floor_div(key, width))
        added = (*stand_ins, BUCKET)
    elif layout == "range":
        ranged = keyed.repartitionByRange(shuffle_partitions(df), *group_keys, *order)
        rows = materialize(ranged.withColumn(BUCKET, F.spark_partition_id().cast("bigint")))
        added, width = (*stand_ins, BUCKET), None
    elif layout == "sketched":
        (key,) = order
        rows, added, width = _cut_by_sketch(keyed, key, group_keys), (*stand_ins, BUCKET), None
    elif layout == "carried":
        rows, added = keyed, stand_ins
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return Cells(rows, (*group_keys, BUCKET), tuple(group_cols), group_keys, added, width)


def _choose(df, order, group_cols, width):
    if len(order) != 1 or not isinstance(order[0], str):
        return "range", None
    kind = df.schema[order[0]].dataType
    general = "sketched" if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)) else "range"
    if group_cols or not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return general, None
    low, high = df.agg(F.min(order[0]), F.max(order[0])).first()
    if low is None:
        return "dense", width
    span = high - low + 1
    width = width or bucket_width(span, shuffle_partitions(df))
    return ("dense", width) if width <= 8 * MAX_WIDTH else (general, None)


def _cut_by_sketch(rows: DataFrame, key: str, group_keys: Sequence[str]) -> DataFrame:
    """Rows with their bucket: 0, or in a group of more than a task's share of the
    rows the number of the group's quantiles below the key."""
    tasks = shuffle_partitions(rows)
    share = -(-rows.count() // tasks)
    sizes = rows.groupBy(*group_keys).agg(F.count(F.lit(1)).alias("_size"))
    # as many rows as tasks at most
    heavy = sizes.where(F.col("_size") > share).orderBy(F.desc("_size")).limit(tasks).collect()
    if not heavy:
        return rows.withColumn(BUCKET, F.lit(0).cast("bigint"))
    pieces = min(MOST_BOUNDS, -(-heavy[0]["_size"] // share))
    at = F.percentile_approx(key, [k / pieces for k in range(1, pieces)], 10 * MOST_BOUNDS).alias("_bounds")
    spark, kinds = rows.sparkSession, [rows.schema[k] for k in group_keys]
    own = rows
    if group_keys:
        names = spark.createDataFrame([tuple(r[k] for k in group_keys) for r in heavy], T.StructType(kinds))
        own = rows.join(F.broadcast(names), list(group_keys))
    found = own.groupBy(*group_keys).agg(at)
    facts = spark.createDataFrame(found.collect(), found.schema)
    steps = F.filter("_bounds", lambda _, k: k % F.lit(STRIDE) == F.lit(STRIDE - 1))
    facts = F.broadcast(facts.withColumn("_steps", steps))
    cut = rows.join(facts, list(group_keys), "left") if group_keys else rows.crossJoin(facts)
    value = F.col(key)
    far = F.size(F.filter("_steps", lambda b: b < value)) * F.lit(STRIDE)
    near = F.size(F.filter(F.slice("_bounds", far + F.lit(1), F.lit(STRIDE - 1)), lambda b: b < value))
    place = F.when(F.col("_bounds").isNotNull(), far + near).otherwise(F.lit(0)).cast("bigint")
    return cut.withColumn(BUCKET, place).drop("_bounds", "_steps")


def non_null_keys(
    df: DataFrame, group_cols: Sequence[str], always: bool = False
) -> tuple[DataFrame, tuple[str, ...]]:
    """Key columns that NULL groups can be joined by with plain equality: the
    group column itself where it cannot be NULL, else a filler and a flag."""
    names: list[str] = []
    for i, name in enumerate(group_cols):
        field = df.schema[name]
        if not field.nullable and not always:
            names.append(name)
            continue
        df = df.withColumns(
            {f"_g{i}": F.coalesce(F.col(name), _filler(field.dataType)), f"_n{i}": F.col(name).isNull()}
        )
        names += [f"_g{i}", f"_n{i}"]
    return df, tuple(names)


def never_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stand-ins that were read from files, which do not say that none is NULL."""
    return df.withColumns({k: F.coalesce(F.col(k), _filler(df.schema[k].dataType)) for k in keys})


def given_groups(group_cols: Sequence[str]) -> list[Column]:
    """The group columns behind stand-ins made with ``always``."""
    return [
        F.when(F.col(f"_n{i}"), F.lit(None)).otherwise(F.col(f"_g{i}")).alias(name)
        for i, name in enumerate(group_cols)
    ]


def _filler(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    raise TypeError(f"cannot group by {kind.simpleString()}")


def cell_sums(cells: Cells, sums: Mapping[str, Column]) -> DataFrame:
    """One row per cell with the given sums."""
    names = [c for c in cells.group_cols if c not in cells.keys]
    return cells.rows.groupBy(*cells.keys, *names).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def join_cells(
    cells: Cells,
    order: Sequence[str | Column],
    running: Mapping[str, Column],
    per_cell: DataFrame,
    totals: Sequence[str],
    derive: Callable[[DataFrame], DataFrame],
    facts: Sequence[str],
    unique: bool = False,
) -> DataFrame:
    """Running sums inside each cell, next to facts about the cell.

    ``per_cell`` has the cell's sum of every running value and total. The
    result has ``local_{name}`` for every running value. ``derive`` gets the
    table of cells, with ``before_{name}`` (the sum over the earlier cells of
    the group), ``group_{name}`` for the totals and the group columns, and adds
    the ``facts`` to be put on the rows; they are worked out once per cell, not
    per row. With ``unique`` a first order column that repeats is refused, by the
    window that runs anyway: equal keys are neighbours in one cell.
    """
    names = [c for c in cells.group_cols if c not in cells.keys]
    types = {f.name: f.dataType for f in per_cell.schema}
    group = Window.partitionBy(*cells.group_keys)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    cell_table = per_cell.select(
        *cells.keys,
        *names,
        *[F.coalesce(F.sum(k).over(earlier), F.lit(0).cast(types[k])).alias(f"before_{k}") for k in running],
        *[F.sum(k).over(group).alias(f"group_{k}") for k in totals],
    )
    inside = Window.partitionBy(*cells.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"local_{k}": F.sum(v).over(inside) for k, v in running.items()}
    if unique:
        own = F.col(order[0]) if isinstance(order[0], str) else order[0]
        before = F.lag(own).over(Window.partitionBy(*cells.keys).orderBy(*order))
        repeated = F.raise_error(F.concat(F.lit("repeated id: "), own.cast("string")))
        sums = {k: F.when(before == own, repeated.cast("bigint")).otherwise(v) for k, v in sums.items()}
    local = cells.rows.withColumns(sums)
    return local.join(derive(cell_table).select(*cells.keys, *facts), list(cells.keys))


def scan(
    cells: Cells, order: Sequence[str | Column], running: Mapping[str, Column], unique: bool = False
) -> DataFrame:
    """Add inclusive running sums; the cell keys stay on the result."""
    before = [f"before_{k}" for k in running]
    joined = join_cells(cells, order, running, cell_sums(cells, running), [], lambda table: table, before, unique)
    return joined.select(
        *cells.rows.columns, *[(F.col(f"local_{k}") + F.col(f"before_{k}")).alias(k) for k in running]
    )


def prefix_sum(
    df: DataFrame,
    value_col: str,
    id_col: str = "id",
    out: str = "prefix",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
    width: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value_col`` by ``id_col``."""
    cells = lay_out(df, [id_col], group_cols, layout, width)
    return cells.drop_keys(scan(cells, [id_col], {out: F.col(value_col)}))


def segmented_prefix_sum(
    df: DataFrame,
    value_col: str,
    group_cols: Sequence[str],
    id_col: str = "id",
    out: str = "prefix",
    layout: str = "auto",
) -> DataFrame:
    """Running sum that starts again in each group."""
    return prefix_sum(df, value_col, id_col, out, group_cols, layout)


def exclusive_prefix(
    df: DataFrame,
    value_col: str,
    id_col: str = "id",
    out: str = "before",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
) -> DataFrame:
    """Sum of the values strictly before each row; zero for the first."""
    summed = prefix_sum(df, value_col, id_col, out, group_cols, layout)
    return summed.withColumn(out, F.col(out) - F.col(value_col))


def adjacent_difference(
    df: DataFrame,
    value_col: str,
    id_col: str = "id",
    out: str = "diff",
    group_cols: Sequence[str] = (),
    layout: str = "auto",
) -> DataFrame:
    """``v[i] - v[i-1]`` by ``id_col``; the first value of a group is kept."""
    cells = lay_out(df, [id_col], group_cols, layout)
    last = cells.rows.groupBy(*cells.keys).agg(F.max_by(value_col, id_col).alias("_last"))
    cell_order = Window.partitionBy(*cells.group_keys).orderBy(BUCKET)
    carried = last.select(
        *cells.keys,
        F.lag("_last").over(cell_order).alias("_carried"),
        (F.row_number().over(cell_order) == F.lit(1)).alias("_first_cell"),
    )
    inside = Window.partitionBy(*cells.keys).orderBy(id_col)
    rows = cells.rows.withColumns(
        {"_prev": F.lag(value_col).over(inside), "_first": F.row_number().over(inside) == F.lit(1)}
    )
    zero = F.lit(0).cast(df.schema[value_col].dataType)
    before = (
        F.when(~F.col("_first"), F.col("_prev")).when(F.col("_first_cell"), zero).otherwise(F.col("_carried"))
    )
    joined = rows.join(carried, list(cells.keys))
    return joined.withColumn(out, F.col(value_col) - before).select(*df.columns, out)


def row_positions(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "position",
    group_cols: Sequence[str] = (),
    layout: str = "range",
    width: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """1-based position of each row in ``order``, dense within a group. With
    ``unique``, rows that share the first order column fail the job."""
    cells = lay_out(df, order, group_cols, layout, width)
    return cells.drop_keys(scan(cells, order, {out: F.lit(1).cast("bigint")}, unique))


def written_once(df: DataFrame, id_col: str, **facts: Column) -> tuple[DataFrame, str, int | None, dict]:
    """Rows written once, with the layout of their cells by an integer id and other
    aggregates, all from the pass that writes: an input that is costly, or read by
    several branches of a plan, is evaluated a single time."""
    rows, found = materialize_observed(df, _low=F.min(id_col), _high=F.max(id_col), **facts)
    low, high = found.pop("_low"), found.pop("_high")
    width = bucket_width(high - low + 1, shuffle_partitions(df)) if low is not None else MIN_WIDTH
    return (rows, "dense", width, found) if width <= 8 * MAX_WIDTH else (rows, "sketched", None, found)
