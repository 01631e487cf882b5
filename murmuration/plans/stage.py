"""Keeping intermediate tables: shared folder, checkpoints, persisted frames."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F


_LOCK = threading.Lock()
_PLANNERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and cut the lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_observed(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """Materialize rows and get aggregates of them from the pass that writes."""
    seen = Observation()
    written = materialize(df.observe(seen, *[value.alias(name) for name, value in facts.items()]))
    return written, seen.get


def keep(df: DataFrame) -> DataFrame:
    """Persist for reuse; lost blocks are recomputed from the lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def write_cached(df: DataFrame) -> DataFrame:
    """Materialize a projection of a persisted frame and remember its partitioning.

    A checkpoint of an adaptive plan forgets how its rows are partitioned, so
    the next window on the same key would shuffle them again. Reading a cache
    needs no exchange, hence nothing for adaptive execution to improve: the frame
    is planned without it in a session of its own, which shares the cache. The
    caller's session keeps its settings, and so do queries of other threads.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with _seen_from(_planner(spark), df) as planned:
        written = materialize(planned)
    with _seen_from(spark, written) as own:
        return own


def _planner(spark: SparkSession) -> SparkSession:
    """One session for each application, in which adaptive execution is off."""
    name = spark.sparkContext.applicationId
    with _LOCK:
        if name not in _PLANNERS:
            own = spark.newSession()
            own.conf.set("spark.sql.adaptive.enabled", "false")
            _PLANNERS.clear()
            _PLANNERS[name] = own
        return _PLANNERS[name]


@contextmanager
def _seen_from(spark: SparkSession, df: DataFrame) -> Iterator[DataFrame]:
    """The same frame in another session, handed over by a view. The view stays
    until the frame has been used, as a cached frame is forgotten with its views."""
    name = f"handed_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        yield spark.table(f"global_temp.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)


def materialize_partitioned(
    df: DataFrame, *aggregates: Column, facts: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, Row | DataFrame]:
    """Materialize rows that a shuffle has just placed, keeping their
    partitioning, and aggregate them in the same pass; ``facts`` writes a table
    made of them instead."""
    cached = keep(df)
    try:
        found = facts(cached) if facts else cached.agg(F.count(F.lit(1)), *aggregates).first()
        return write_cached(cached), found
    finally:
        cached.unpersist()


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rebalance(df: DataFrame, partitions: int | None = None, *keys: str) -> DataFrame:
    """Spread rows evenly over ``partitions``, by ``keys`` when given."""
    return df.repartition(partitions or shuffle_partitions(df), *keys)


def shrink(df: DataFrame, partitions: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(partitions)
