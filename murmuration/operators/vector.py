"""Row-wise operators on key/value vectors; none of them shuffles, except
where a row is expanded into many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.functions.model import INITIAL_VARIANCE, StateSpaceModel
from murmuration.functions.noise import Noise
from murmuration.functions.slots import node_of, position_in_node
from murmuration.operators.resample import CHUNK, cut_ranges
from murmuration.plans.stage import shuffle_partitions


def init_particles(
    df: DataFrame,
    noise: Noise,
    variance: float = INITIAL_VARIANCE,
    id_col: str = "id",
    state_col: str = "x",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Prior draw: the given state plus ``sqrt(variance)`` standard normals."""
    draw = noise.gaussian(0, *group_cols, id_col)
    return df.withColumn(state_col, F.col(state_col) + F.sqrt(F.lit(float(variance))) * draw)


def propagate_state(
    df: DataFrame,
    model: StateSpaceModel,
    noise: Noise,
    step: int,
    id_col: str = "id",
    state_col: str = "x",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Move every state one step on."""
    moved = model.transition(F.col(state_col), F.lit(step), noise.gaussian(step, *group_cols, id_col))
    return df.withColumn(state_col, moved)


def node_bucket(df: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """The 1-based node of ``size`` consecutive keys each row belongs to."""
    return df.withColumn("node", node_of(F.col(id_col), size))


def clamp_counts(df: DataFrame, count: str, limit: Column) -> DataFrame:
    """The count held below and above a limit."""
    return df.withColumns({"low": F.least(F.col(count), limit), "high": F.greatest(F.col(count), limit)})


def half_filter(df: DataFrame, size: int, lower: bool = True, id_col: str = "id") -> DataFrame:
    """The lower or upper half of each node's keys."""
    in_lower = position_in_node(F.col(id_col), size) < F.lit(size / 2)
    return df.where(in_lower if lower else ~in_lower)


def threshold_flag(df: DataFrame, condition: Column, out: str = "flag") -> DataFrame:
    """1 where the condition holds, else 0."""
    return df.withColumn(out, F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def negate_flag(df: DataFrame, flag: str = "flag", out: str = "negated") -> DataFrame:
    return df.withColumn(out, F.lit(1) - F.col(flag))


def rekey(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """Replace the key by arithmetic on the row."""
    return df.withColumn(id_col, key)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows that hold no value in any of the columns."""
    present = F.coalesce(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return df.where(present.isNotNull())


def tag_and_pair(df: DataFrame, key: Column, parts: Mapping[str, str], out: str = "pair") -> DataFrame:
    """Rows as (new key, struct of the named parts)."""
    fields = F.struct(*[F.col(source).alias(name) for name, source in parts.items()])
    return df.select(key.alias("key"), fields.alias(out))


def range_expand(df: DataFrame, lo: Column, hi: Column, out: str = "id") -> DataFrame:
    """One row for each key ``lo .. hi``. Ranges may overlap: wide ones are cut,
    and the pieces are dealt out evenly, whatever keys they cover."""
    ranged = df.withColumns({"_lo": (lo - F.lit(1)).cast("bigint"), "_hi": hi.cast("bigint")})
    pieces = cut_ranges(ranged, F.col("_lo"), F.col("_hi"), CHUNK, "_piece")
    step = F.lit(CHUNK).cast("bigint")
    first = F.greatest(F.col("_lo"), F.col("_piece") * step) + F.lit(1)
    last = F.least(F.col("_hi"), (F.col("_piece") + F.lit(1)) * step)
    dealt = pieces.repartition(shuffle_partitions(df))
    return dealt.withColumn(out, F.explode(F.sequence(first, last))).drop("_lo", "_hi", "_piece")
