"""Nearest vectors by cosine, through an inverted multi-index.

Vectors of each length are an index of their own. Unit vectors are cut in halves,
and each half is quantised by its own codebook, fitted by k-means on a bounded
sample (``FIT_ROWS`` rows, those with the smallest hash). A cell is a pair of codes;
there are a few times as many cells as the square root of the vectors. A query visits cells by the sum of its two
distances, which a heap yields in ascending order, until they hold a share of
all vectors; the share is the smallest of ``SHARES`` that finds ``TARGET`` of the
true neighbours of sample queries within the sample. Visited entries are ranked
again by the exact cosine of the original vectors.

Every vector is indexed. Equal vectors are one entry with its k + 1 smallest
ids, which is all that a list of k can use, so copies cannot crowd a cell; a
cell of many different vectors is dealt over shards. A query goes to the shards
of the cells it visits and is compared with those cells alone; a shard's entries
are held once, its queries stream past them, and k rows for each leave it. Of a
length that few vectors have (``FEW``), all are compared.

Vectors that are null, zero, empty, or hold nulls or non-finite numbers take no
part, nor do rows without an id. Only vectors of one length can be compared: a
query's candidates are those of its own. Rows that repeat an id and its vector
count once; if an id has several vectors, each is a candidate, and a query per
vector would be ambiguous, so the id's largest vector (in array order) asks. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm.common import Batches, spread, stored

FIT_ROWS = 20_000
FIT_QUERIES = 200
#: Codes of each half at most.
MOST_CODES = 512
#: Vectors of one length that are searched without codes.
FEW = 4096
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
TARGET = 0.97
SHARD_ROWS = 8192
#: How far fast and exact scores may differ.
SLACK = 1e-9
K = 5
EVERY = 50


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): ids and vectors of doubles that can take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null")
    largest = F.lit(1.7976931348623157e308)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= largest))
    return rows.filter(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles, on the vectors as they are."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        at = codes_of(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]).clip(0)


def codes_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(axis=1)


def cells_in_order(first: np.ndarray, second: np.ndarray):
    """Pairs of codes by the sum of two distances: the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


class Codebooks:
    def __init__(self, sample: np.ndarray, codes: int):
        self.size = sample.shape[1]
        self.half = max(1, self.size // 2)
        x = unit(sample)
        self.books = [k_means(part, codes) for part in self.halves(x)]
        self.codes = codes

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        right = x[:, self.half :]
        return [x[:, : self.half], right if right.shape[1] else np.zeros((len(x), 1))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (codes_of(part, book) for part, book in zip(self.halves(unit(x)), self.books, strict=True))
        return a * self.codes + b

    def visits(self, x: np.ndarray, counts: np.ndarray, wanted: int) -> list[list[int]]:
        """The cells each row looks into, until they hold ``wanted`` entries."""
        tables = [distances(part, book) for part, book in zip(self.halves(unit(x)), self.books, strict=True)]
        out = []
        for first, second in zip(*tables, strict=True):
            own, held = [], 0
            for a, b in cells_in_order(first, second):
                cell = a * self.codes + b
                if counts[cell]:
                    own.append(cell)
                    held += counts[cell]
                    if held >= wanted:
                        break
            out.append(own)
        return out


def calibrated(books: Codebooks, sample: np.ndarray, k: int = K, target: float = TARGET) -> float:
    """The share of entries to visit, measured on the sample itself."""
    x = unit(sample)
    queries = np.linspace(0, len(x) - 1, min(FIT_QUERIES, len(x))).astype(int)
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cells = books.cells(sample)
    counts = np.bincount(cells, minlength=books.codes**2)
    for share in SHARES:
        visits = books.visits(sample[queries], counts, int(np.ceil(share * len(x))) + k)
        found = sum(np.isin(cells[t], v).sum() for t, v in zip(true, visits, strict=True))
        if found >= target * k * len(queries):
            return share
    return 1.0


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): equal vectors once, with their k + 1 smallest ids. Copies are
    dealt by a hash of the id as well, so that no task ranks them all."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    rank = F.row_number().over(W.partitionBy("v", "salt").orderBy("vec_id"))
    few = salted.withColumn("r", rank).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def codes_for(n: int) -> int:
    """Codes of a half: as many cells as a few times the square root of the entries."""
    return int(min(MOST_CODES, max(4, round(2 * n**0.25))))


def shards_of(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first shard and its number of shards: small cells share
    one, a cell of more than ``rows`` entries has several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[cell] = at
        if n > rows:
            parts[cell] = -(-n // rows)
            at += int(parts[cell])
        else:
            held += n
    return first, parts


class Space:
    """Where vectors of one length are kept, and where a query looks: all in one
    cell if they are few."""

    def __init__(self, books: Codebooks | None, share: float):
        self.books, self.share = books, share
        self.n_cells = books.codes**2 if books else 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self.books.cells(x) if self.books else np.zeros(len(x), np.int64)

    def fill(self, counts: np.ndarray, k: int, shard_rows: int) -> None:
        self.counts = counts
        self.first, self.parts = shards_of(counts, shard_rows)
        self.wanted = int(np.ceil(self.share * counts.sum())) + k + 1

    def visits(self, x: np.ndarray) -> list[list[int]]:
        return self.books.visits(x, self.counts, self.wanted) if self.books else [[0]] * len(x)


Spaces = dict[int, Space]


def _by_length(column: pa.Array):
    """(length, positions, matrix) for each length of vector in a column."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def _record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    made = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(made, schema, strict=True)], schema=schema)


MET = "size int, shard bigint, query_id bigint, cell bigint, v array<double>, ids array<bigint>, cells array<bigint>"
_MET = pa.schema(
    [
        ("size", pa.int32()),
        ("shard", pa.int64()),
        ("query_id", pa.int64()),
        ("cell", pa.int64()),
        ("v", pa.list_(pa.float64())),
        ("ids", pa.list_(pa.int64())),
        ("cells", pa.list_(pa.int64())),
    ]
)


def _counted(shared):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for size, _, x in _by_length(batch.column("v")):
                cells, n = np.unique(shared.value[size].cells(x), return_counts=True)
                sizes = pa.array(np.full(len(cells), size, np.int32))
                yield pa.RecordBatch.from_arrays([sizes, pa.array(cells), pa.array(n)], ["size", "cell", "n"])

    return run


def _placed(shared):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for size, at, x in _by_length(batch.column("v")):
                space, rows = shared.value[size], batch.take(pa.array(at))
                cell = space.cells(x)
                shard = space.first[cell] + rows.column("salt").to_numpy() % space.parts[cell]
                own = {c: rows.column(c) for c in ("v", "ids")}
                yield _record(_MET, {"size": np.full(len(at), size, np.int32), "shard": shard, "cell": cell, **own})

    return run


def _visiting(shared):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for size, at, x in _by_length(batch.column("v")):
                space, row, shard, cells = shared.value[size], [], [], []
                for k, own in zip(at.tolist(), space.visits(x), strict=True):
                    by_shard: dict[int, list[int]] = {}
                    for cell in own:
                        for s in range(space.first[cell], space.first[cell] + space.parts[cell]):
                            by_shard.setdefault(int(s), []).append(cell)
                    row += [k] * len(by_shard)
                    shard += by_shard.keys()
                    cells += by_shard.values()
                rows = batch.take(pa.array(row, pa.int64()))
                yield _record(
                    _MET,
                    {
                        "size": np.full(len(row), size, np.int32),
                        "shard": shard,
                        "query_id": rows.column("vec_id"),
                        "v": rows.column("v"),
                        "cells": cells,
                    },
                )

    return run


class Shard:
    """Entries by cell; a query is compared with those of the cells it visits."""

    def __init__(self, x: np.ndarray, cell: np.ndarray, ids: list[list[int]]):
        order = np.argsort(cell, kind="stable")
        self.x, self.ids = x[order], [ids[i] for i in order.tolist()]
        self.near = unit(self.x)
        self.cells, first = np.unique(cell[order], return_index=True)
        self.bounds = dict(zip(self.cells.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))

    def search(self, queries: list[int], q: np.ndarray, visits: list[list[int]], k: int) -> list[tuple[int, int, float]]:
        """(query, id, score): the k best of each query, all that tie with the last."""
        asked: dict[int, list[int]] = {}
        for row, cells in enumerate(visits):
            for c in cells:
                if c in self.bounds:
                    asked.setdefault(c, []).append(row)
        near, rows, entries, scores = unit(q), [], [], []
        for c, own in asked.items():
            a, b = self.bounds[c]
            block = near[own] @ self.near[a:b].T
            keep = block >= _edge(block, k)
            at, e = np.nonzero(keep)
            rows.append(np.array(own)[at])
            entries.append(e + a)
            scores.append(block[keep])
        if not rows:
            return []
        row, entry, score = (np.concatenate(v) for v in (rows, entries, scores))
        order = np.lexsort((-score, row))
        row, entry, score = row[order], entry[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out: list[tuple[int, int, float]] = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
            # one more than k entries, as one may be the query's own
            edge = score[min(a + k, b - 1)] - SLACK
            best = entry[a:b][score[a:b] >= edge]
            query = queries[row[a]]
            exact = cosine(self.x[best], np.broadcast_to(q[row[a]], self.x[best].shape))
            own = [(-s, i) for s, e in zip(exact.tolist(), best.tolist(), strict=True) for i in self.ids[e] if i != query]
            out += [(query, i, -s) for s, i in heapq.nsmallest(k, own)]
        return out


def _edge(block: np.ndarray, k: int) -> np.ndarray:
    """For each row the (k + 1)-th largest value, a little less for rounding."""
    n = block.shape[1]
    if n <= k + 1:
        return np.full((len(block), 1), -2.0)
    return np.partition(block, n - k - 1, axis=1)[:, n - k - 1 : n - k] - SLACK


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _ranked(k: int):
    """Entries of a shard come before its queries, of which any number may follow."""

    def run(batches: Batches) -> Batches:
        now, held, shard = None, [], None
        for batch in batches:
            sizes, shards = batch.column("size").to_numpy(), batch.column("shard").to_numpy()
            asks = np.array([not x for x in batch.column("query_id").is_null().to_pylist()], bool)
            change = (sizes[1:] != sizes[:-1]) | (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(sizes)] if len(sizes) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key, part = (sizes[a], shards[a]), batch.slice(a, b - a)
                if key != now:
                    now, held, shard = key, [], None
                column = part.column("v")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(sizes[a]))
                if not asks[a]:
                    held.append((x, part.column("cell").to_numpy(), part.column("ids").to_pylist()))
                    continue
                if shard is None and held:
                    shard = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), sum((h[2] for h in held), []))
                if shard is not None:
                    out = shard.search(part.column("query_id").to_pylist(), x, part.column("cells").to_pylist(), k)
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND
                        )

    return run


def fit(rows: DataFrame, k: int = K, share: float | None = None, codes: int | None = None, fit_rows: int = FIT_ROWS, few: int = FEW) -> Spaces:
    """A space for every length of vector. The sample of a length is bounded, and so
    are the lengths that have one: those of more than ``few`` vectors."""
    spaces: Spaces = {}
    for size, n in rows.groupBy(F.size("v").alias("size")).count().collect():
        spaces[size] = Space(None, 1.0)
        if n > few:
            own = rows.filter(F.size("v") == size).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(fit_rows)
            sample = np.array([r.v for r in own.select("v").collect()])
            books = Codebooks(sample, codes or codes_for(n))
            spaces[size] = Space(books, calibrated(books, sample, k) if share is None else share)
    return spaces


def nearest(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    share: float | None = None,
    codes: int | None = None,
    fit_rows: int = FIT_ROWS,
    shard_rows: int = SHARD_ROWS,
    few: int = FEW,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is a multiple of
    ``every``, its ``k`` nearest of those found, or all others if fewer."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    spaces = fit(rows, k, share, codes, fit_rows, few)
    if not spaces:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    entries = stored(_entries(rows, k), "entries")
    fitted = spark.sparkContext.broadcast(spaces)  # of bounded samples
    counts = {size: np.zeros(space.n_cells, np.int64) for size, space in spaces.items()}
    cells = entries.select("v").mapInArrow(_counted(fitted), "size int, cell bigint, n bigint")
    for size, cell, n in cells.groupBy("size", "cell").agg(F.sum("n")).collect():  # a row per cell at most
        counts[size][cell] = n
    for size, space in spaces.items():
        space.fill(counts[size], k, shard_rows)
    shared = spark.sparkContext.broadcast(spaces)
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    queries = spread(asking, "vec_id").mapInArrow(_visiting(shared), MET)
    placed = entries.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(1 << 30))).mapInArrow(_placed(shared), MET)
    met = spread(placed.union(queries), "size", "shard").sortWithinPartitions("size", "shard", F.asc_nulls_first("query_id"))
    found = met.mapInArrow(_ranked(k), "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
