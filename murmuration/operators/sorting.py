"""Global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.plans.stage import materialize

#: Above these bits, ``monotonically_increasing_id`` holds the partition.
PART_SHIFT = 33


def sort_by_copies(
    df: DataFrame, count_col: str = "n_copies", id_col: str = "id", with_position: bool = False
) -> DataFrame:
    """Rows by copies, most first, ties by id.

    The range exchange samples (copies, id), so the many rows that share a
    count do not end up in one task. ``with_position`` adds the 1-based rank:
    the place in the sorted partition, which is kept, after the rows of all
    partitions before it. The rows are shuffled once.
    """
    ordered = df.orderBy(F.desc(count_col), F.asc(id_col))
    if not with_position:
        return ordered
    kept = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = kept.withColumn("_part", F.shiftright("_at", PART_SHIFT))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")
    # one row per partition
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_at") - F.shiftleft("_part", PART_SHIFT)
    found = placed.join(starts, "_part").withColumn("position", F.col("_before") + place + F.lit(1))
    return found.drop("_at", "_part", "_before")
