"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from murmuration.plans.stage import run_folder, shuffle_partitions

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder once; what follows reads the files,
    so a lost executor costs no more than the step it was in."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning with a fixed number of partitions."""
    return df.repartition(shuffle_partitions(df), *keys)


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold zero of five by the crc32 of the id as text; a null id as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def arrow_schema(spec: str) -> pa.Schema:
    """The Arrow form of a DDL string of plain types and arrays of them."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
        "array<binary>": pa.list_(pa.binary()),
        "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in spec.split(","))])


def give_back() -> None:
    """Memory that is not in use goes back to the system: a worker outlives its task,
    and what Arrow and the C library hold for it adds up over the stages of a run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Batches, rows: int = 500) -> Batches:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    batch = None
    give_back()


def map_rows(df: DataFrame, spec: str, columns: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """One batch in, one batch out: ``columns`` gives the output by name."""
    schema = arrow_schema(spec)

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            made = columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ", ".join(f"{p.split()[0]} {p.split()[1]}" for p in spec.split(",")))
