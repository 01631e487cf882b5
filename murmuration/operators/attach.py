"""Giving every row the facts of its key.

Facts are one row per key. They are broadcast only after their bytes have been
estimated, from their number and the length of their texts, and found small. Beyond that, keys are split by how many rows they have: the
few heavy ones (their number is bounded by the share a heavy key must hold) are
broadcast, and the rest, none of which is heavy, go through a shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.plans.stage import materialize, shuffle_partitions

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: What a column takes in a hashed relation, besides the bytes of a text.
COLUMN_BYTES = 16


def estimated_bytes(facts: DataFrame, n_facts: int) -> int:
    """Exact for the texts, which need a pass; flat for columns of fixed size."""
    flat = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}
    sized = [c for c, kind in facts.dtypes if kind not in flat and not kind.startswith("decimal")]
    total = n_facts * COLUMN_BYTES * len(facts.columns)
    if sized and n_facts:
        text = F.to_json(F.struct(*[F.col(c) for c in sized]))
        total += facts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(total)


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    n_facts: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``facts`` (unique on ``keys``) to ``rows``; ``how`` is inner or left.

    NULL keys match each other. ``n_facts`` is an upper bound on the number of
    facts where the caller has one; otherwise they are written once and counted.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if n_facts is None:
        facts = materialize(facts)
        n_facts = facts.count()
    if n_facts <= broadcast_rows and estimated_bytes(facts, n_facts) <= broadcast_bytes:
        return match_keys(rows, F.broadcast(facts), keys, how)

    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    most = max(1, min(broadcast_rows, 4 * shuffle_partitions(rows)))
    heavy = sizes.where(F.col("_rows") > F.lit(total // most)).drop("_rows")
    heavy_facts = materialize(match_keys(heavy, facts, keys, how))
    if estimated_bytes(heavy_facts, most) > broadcast_bytes:
        # facts too wide even for the few heavy keys: adaptive execution splits the join
        return match_keys(rows, facts, keys, how)
    heavy_facts = F.broadcast(heavy_facts)
    light_rows = match_keys(rows, F.broadcast(heavy), keys, "left_anti")
    return match_keys(rows, heavy_facts, keys, "inner").unionByName(match_keys(light_rows, facts, keys, how))


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL matching NULL."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = _all([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result
