"""Lines that many documents share, dropped reversibly.

The state of the index is four tables in the shared folder: which document
holds which key (``postings``), how many documents hold a key and which is the
largest (``counts``, exact), and per shard of the keys a cuckoo filter. A batch of
documents is counted by key before anything else, so a line of very many
documents is one row per task. The filter of a shard then tells which keys are
certainly new: their counts are appended without a look at the exact table, and
only the others are merged into it. Deleting documents lowers the counts,
finds the new largest holder from the postings of the keys concerned alone, and
takes keys that nobody holds any more out of the filter.

Keys are 16-byte digests of the line without ASCII white space at its ends and
with A-Z in lower case; lines of fewer than ``min_chars`` code points have none.
Null or empty texts are one empty line. Rows without an id are left whole and
not counted; rows that repeat an id are one document. Very long texts and lines are
taken whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.llm.common import Batches, pieces, stored, text_of
from murmuration.llm.cuckoo import CuckooFilter
from murmuration.plans.stage import shuffle_partitions

MIN_CHARS = 20
MIN_DOCS = 3
#: Insertions that make up an index of all documents.
PARTS = 2
BLANKS = " \t\n\x0b\x0c\r"

POSTINGS = "shard int, key binary, doc_id bigint"
COUNTS = "shard int, key binary, n_docs bigint, max_doc bigint"
FILTERS = "shard int, cuckoo binary, n_keys bigint"
MARKED = "shard int, key binary, n_docs bigint, max_doc bigint, known boolean, cuckoo binary, n_keys bigint"


FILTER_ARROW = pa.schema([("shard", pa.int32()), ("cuckoo", pa.binary()), ("n_keys", pa.int64())])
MARKED_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("key", pa.binary()),
        ("n_docs", pa.int64()),
        ("max_doc", pa.int64()),
        ("known", pa.bool_()),
        ("cuckoo", pa.binary()),
        ("n_keys", pa.int64()),
    ]
)


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    bare = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(bare.encode().lower()) if len(bare) >= min_chars else None


def _keys(batches: Batches, min_chars: int, shards: int) -> Batches:
    for batch in pieces(batches):
        keys, docs = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {k for line in text.split("\n") if (k := line_key(line, min_chars))}
            keys.extend(own)
            docs.extend([doc] * len(own))
        shard = [int.from_bytes(k[:4]) % shards for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int32()), pa.array(keys, pa.binary()), pa.array(docs, pa.int64())],
            ["shard", "key", "doc_id"],
        )


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """The last eight bytes of every key; the first chose the shard."""
    joined = b"".join(keys.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(-1, 2)[:, 1]


def _screen(counts: pa.Table, filters: pa.Table) -> pa.Table:
    """Mark the keys that the shard's filter knows, and add the others to it."""
    hashes = _hashes(counts.column("key")) if counts.num_rows else np.zeros(0, np.uint64)
    held = filters.column("n_keys")[0].as_py() if filters.num_rows else 0
    cuckoo = CuckooFilter.from_bytes(filters.column("cuckoo")[0].as_py()) if held else CuckooFilter.for_keys(0)
    known = cuckoo.contains(hashes)
    fresh = hashes[~known]
    room = cuckoo.table.size * 0.8
    full = held + len(fresh) > room or not cuckoo.insert(fresh)
    n = counts.num_rows
    shard = (counts if n else filters).column("shard")[0].as_py()
    rows = pa.table(
        [
            counts.column("shard"),
            counts.column("key"),
            counts.column("n_docs"),
            counts.column("max_doc"),
            pa.array(known, pa.bool_()),
            pa.nulls(n, pa.binary()),
            pa.nulls(n, pa.int64()),
        ],
        schema=MARKED_ARROW,
    )
    # a filter that is full is made anew from the exact table by the caller
    own = {"shard": shard, "cuckoo": None if full else cuckoo.to_bytes(), "n_keys": held + len(fresh)}
    return pa.concat_tables([rows, pa.Table.from_pylist([own], schema=MARKED_ARROW)])


def _add(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys that the filter took for known and the exact table does not hold."""
    if not filters.num_rows:  # to be made anew in any case
        return FILTER_ARROW.empty_table()
    row = filters.to_pylist()[0]
    if keys.num_rows:
        cuckoo = CuckooFilter.from_bytes(row["cuckoo"])
        done = cuckoo.insert(_hashes(keys.column("key")))
        row |= {"cuckoo": cuckoo.to_bytes() if done else None, "n_keys": row["n_keys"] + keys.num_rows}
    return pa.Table.from_pylist([row], schema=FILTER_ARROW)


def _build(keys: pa.Table) -> pa.Table:
    hashes = _hashes(keys.column("key"))
    n = len(hashes)
    while True:
        cuckoo = CuckooFilter.for_keys(n)
        if cuckoo.insert(hashes):
            break
        n *= 2
    return pa.table(
        [[keys.column("shard")[0].as_py()], [cuckoo.to_bytes()], [len(hashes)]],
        schema=FILTER_ARROW,
    )


def _forget(counts: pa.Table, filters: pa.Table) -> pa.Table:
    cuckoo = CuckooFilter.from_bytes(filters.column("cuckoo")[0].as_py())
    if counts.num_rows:
        cuckoo.delete(_hashes(counts.column("key")))
    return pa.table(
        [filters.column("shard"), [cuckoo.to_bytes()], [filters.column("n_keys")[0].as_py() - counts.num_rows]],
        schema=FILTER_ARROW,
    )


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @staticmethod
    def empty(spark: SparkSession, shards: int, min_chars: int = MIN_CHARS) -> LineIndex:
        made = (spark.createDataFrame([], spec) for spec in (POSTINGS, COUNTS, FILTERS))
        return LineIndex(*made, shards, min_chars)

    def _postings(self, docs: DataFrame) -> DataFrame:
        chars, shards = self.min_chars, self.shards
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).filter("doc_id is not null")
        return rows.mapInArrow(lambda batches: _keys(batches, chars, shards), POSTINGS)

    def insert(self, docs: DataFrame, sure: bool = False) -> LineIndex:
        """The index with these documents added. Ids that it holds are refused, as
        their lines would count twice, unless the caller is ``sure`` of them."""
        added = stored(self._postings(docs), "postings")
        if not sure:
            held = added.select("doc_id").distinct().join(self.postings.select("doc_id"), "doc_id", "left_semi")
            if row := held.first():
                raise ValueError(f"the index already holds document {row.doc_id}")
        # a row that repeats an id holds the line once
        counted = added.groupBy("shard", "key").agg(
            F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")
        )
        by_shard = (x.groupBy("shard") for x in (counted, self.filters))
        left, right = by_shard
        marked = stored(left.cogroup(right).applyInArrow(_screen, MARKED), "marked")
        rows = marked.filter("key is not null").select("shard", "key", "n_docs", "max_doc", "known")
        fresh = rows.filter("not known").drop("known")
        merged = (
            self.counts.union(rows.filter("known").drop("known"))
            .groupBy("shard", "key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        )
        counts = stored(merged.union(fresh), "counts")
        missed = rows.filter("known").join(self.counts, ["shard", "key"], "left_anti")
        missed = missed.select(F.col("shard").alias("shard"), "key")  # columns of its own, for the cogroup
        own = marked.filter("key is null").select("shard", "cuckoo", "n_keys")
        fit = own.filter("cuckoo is not null")
        own = stored(
            own.filter("cuckoo is null").union(
                missed.groupBy("shard").cogroup(fit.groupBy("shard")).applyInArrow(_add, FILTERS)
            ),
            "filters",
        )
        full = own.filter("cuckoo is null").select("shard")  # one row per shard
        again = counts.join(F.broadcast(full), "shard", "left_semi").select("shard", "key")
        rebuilt = again.groupBy("shard").applyInArrow(_build, FILTERS)
        filters = stored(own.filter("cuckoo is not null").union(rebuilt), "filters")
        return LineIndex(self.postings.union(added), counts, filters, self.shards, self.min_chars)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents (column ``doc_id``)."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        postings = stored(self.postings.join(gone, "doc_id", "left_anti").select("shard", "key", "doc_id"), "postings")
        touched = stored(
            self.postings.join(gone, "doc_id", "left_semi").select("shard", "key").distinct(),
            "touched",
        )
        again = (
            postings.join(touched, ["shard", "key"], "left_semi")
            .groupBy("shard", "key")
            .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        )
        rest = self.counts.join(touched, ["shard", "key"], "left_anti")
        counts = stored(rest.unionByName(again), "counts")
        orphans = touched.join(counts, ["shard", "key"], "left_anti")
        filters = stored(
            orphans.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_forget, FILTERS), "filters"
        )
        return LineIndex(postings, counts, filters, self.shards, self.min_chars)

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        often = self.counts.filter(F.col("n_docs") >= min_docs).select("key", "max_doc")
        lost = self.postings.join(often, "key").filter("doc_id < max_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def index_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None, parts: int = PARTS
) -> LineIndex:
    """An index of all documents, inserted in ``parts``: from the second on, the
    filters of the parts before say which keys are new. A shard is what one task
    holds of distinct keys at a time, so their number must grow with the corpus; it
    follows the session's number of shuffle partitions unless given."""
    n = shards or 4 * shuffle_partitions(docs)
    index = LineIndex.empty(docs.sparkSession, n, min_chars)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(parts))  # an id is of one part
    for k in range(parts):
        index = index.insert(docs.filter(part == k), sure=True)
    return index


def _kept(min_chars: int, digest: bool):
    def lines_of(text: str, gone: set[bytes]) -> Iterator[str]:
        for line in text.split("\n"):
            if not gone or line_key(line, min_chars) not in gone:
                yield line

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            docs, texts, keys = (batch.column(c) for c in ("doc_id", "text", "keys"))
            kept, before, after = [], [], []
            for text, gone in zip(texts.to_pylist(), keys.to_pylist(), strict=True):
                lines = list(lines_of(text, set(gone or ())))
                kept.append("\n".join(lines))
                before.append(text.count("\n") + 1)
                after.append(len(lines))
            if digest:
                kept = [hashlib.sha256(t.encode()).hexdigest() for t in kept]
            dropped = np.array(before) - np.array(after)
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(before, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return run


def dedup_lines(
    docs: DataFrame, index: LineIndex | None = None, min_docs: int = MIN_DOCS, digest: bool = False
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of ``docs`` with the lines
    that stay, or the SHA-256 of them. A line goes if at least ``min_docs``
    documents of the index hold it, except from the largest of them."""
    index = index or index_lines(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    found = rows.join(index.drops(min_docs), "doc_id", "left").select("doc_id", "text", "keys")
    return found.mapInArrow(
        _kept(index.min_chars, digest), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    )
