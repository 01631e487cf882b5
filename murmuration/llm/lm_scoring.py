"""Documents scored by a language model learnt from nine tenths of them.

The model is a byte-context trie (``ppm``) over the tokens of a text, one blank
between them and an end after them. All counts are of the whole training corpus,
and nothing that grows with it is broadcast or collected:

* Where texts are read they are packed into batches of some megabytes. A batch
  states each distinct event once: a symbol with the bytes before it, or a word,
  and how often training documents have it. Events go to shards, symbols by the
  two bytes before them, words by their hash; a shard's events of a batch are one
  row.
* Counts of a shard are added up in two steps, as a stream of rows. That is the
  shard's part of the trie: a context of two bytes or more lies in one shard with
  all that continue it. Of shorter contexts there are 257 at most; their counts
  (256 by 256) go to every task.
* The batches' rows meet the shard's counts and get their values, again as a
  stream. A shard asked by many batches is dealt over several tasks.
* Values return to their batch, where the texts are, and are added up by document.

There are as many shards as the bytes of the corpus ask for. A task holds a
batch, or a shard's counts and one row.

Words: letters A-Z count as a-z; words are what ASCII white space separates. Null
and empty texts are the end alone. A null ``doc_id`` counts as an empty one, whose
remainder is 0: it is held out. Rows that repeat an id are documents of their own.
Very long texts are taken whole, as batches of their own. Without training
documents all symbols are equally likely. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from murmuration.llm import ppm
from murmuration.llm.common import Batches, pieces, stored, text_of
from murmuration.plans.stage import run_folder, shuffle_partitions

FOLDS = 10
#: Bytes of text to a batch, and to a shard, about.
BATCH_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Events asked of a shard in one task, about.
ASKED = 1 << 23
#: Batches whose counts are added up first.
MERGED = 64
TEXTS, SYMBOLS, WORDS = 0, 1, 2
#: What a batch gets back for a symbol (its logarithm, 24 bits of it) and a word (its count).
VALUES = {SYMBOLS: "<f4", WORDS: "<i8"}
ROWS = "batch long, shard int, n long, keys binary, counts binary, ids array<long>, held array<boolean>, kind int"
COUNTS = "kind int, shard int, keys binary, counts binary"
_ROWS = pa.schema(
    [
        ("batch", pa.int64()),
        ("shard", pa.int32()),
        ("n", pa.int64()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
        ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("kind", pa.int32()),
    ]
)


def learns(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != 0


def plain(text: str) -> bytes:
    """The tokens, one blank between them."""
    return b" ".join(text.encode().lower().split())


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers of any fixed width, compressed byte by byte."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes(), 3)


def unpack_numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(kind: int, keys) -> bytes:
    """Keys of one row: ascending integers as differences, words by lines."""
    if kind == WORDS:
        return zstandard.compress(b"\n".join(keys), 3)
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(kind: int, raw: bytes):
    if kind == WORDS:
        return zstandard.decompress(raw).split(b"\n")
    return np.cumsum(unpack_numbers(raw, "<u8"), dtype=np.uint64)


class Events:
    """The distinct events of a batch, in the order of (shard, key) for symbols
    and (shard, first seen) for words, and which of them the texts consist of."""

    def __init__(self, texts: list[bytes], shard_bits: int, order: int):
        keys, self.symbols, self.symbol_counts = ppm.events(texts, order)
        pair = (keys >> np.uint64(8 * (order - 1))).astype(np.int64) & 0xFFFF
        shards = (pair * 40503 & 0xFFFF) >> 16 - shard_bits
        by = np.lexsort((keys, shards))
        self.keys, self.key_shards = keys[by], shards[by]
        self.symbol_place = _inverse(by)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        tokens = [[*t.split(), b""] for t in texts]  # the end is the empty word
        flat = [w for own in tokens for w in own]
        self.words_at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.word_counts = np.array([len(own) for own in tokens], np.int64)
        names = list(number)
        shards = np.array([xxhash.xxh32_intdigest(w) & (1 << shard_bits) - 1 for w in names], np.int64)
        by = np.argsort(shards, kind="stable")
        self.words, self.word_shards = [names[i] for i in by.tolist()], shards[by]
        self.word_place = _inverse(by)

    def counts(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the texts marked as used have each key, and each word."""
        symbols = self.symbols[np.repeat(used, self.symbol_counts)]
        words = self.words_at[np.repeat(used, self.word_counts)]
        return (
            np.bincount(self.symbol_place[symbols], minlength=len(self.keys)),
            np.bincount(self.word_place[words], minlength=len(self.words)),
        )

    def by_symbol(self, values: np.ndarray) -> np.ndarray:
        """Sums of the keys' values by text; a text has one symbol at least."""
        firsts = np.cumsum(self.symbol_counts) - self.symbol_counts
        return np.add.reduceat(values[self.symbol_place[self.symbols]], firsts)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        firsts = np.cumsum(self.word_counts) - self.word_counts
        return np.add.reduceat(values[self.word_place[self.words_at]], firsts)


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ROWS)


def _batch_rows(batch: int, ids: list, texts: list[bytes], shard_bits: int, order: int) -> Iterator[pa.RecordBatch]:
    held = [not learns(i) for i in ids]
    packed = zstandard.compress(b"\n".join(texts), 3)
    yield _record([{"batch": batch, "shard": -1, "n": len(ids), "keys": packed, "ids": ids, "held": held, "kind": TEXTS}])
    events = Events(texts, shard_bits, order)
    sides = (SYMBOLS, events.keys, events.key_shards), (WORDS, events.words, events.word_shards)
    for (kind, keys, shards), counts in zip(sides, events.counts(~np.array(held)), strict=True):
        first = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))).tolist()
        yield _record(
            [
                {
                    "batch": batch,
                    "shard": int(shards[a]),
                    "n": b - a,
                    "keys": pack_keys(kind, keys[a:b]),
                    "counts": pack_numbers(counts[a:b].astype("<i8")),
                    "kind": kind,
                }
                for a, b in zip(first, [*first[1:], len(shards)], strict=True)
            ]
        )


def _packed(shard_bits: int, order: int, batch_bytes: int):
    def run(batches: Batches) -> Batches:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for rows in pieces(batches):
            for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                own = plain(text)
                if ids and size + len(own) > batch_bytes:
                    yield from _batch_rows(base + made, ids, texts, shard_bits, order)
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(doc)
                texts.append(own)
                size += len(own)
        if ids:
            yield from _batch_rows(base + made, ids, texts, shard_bits, order)

    return run


class Tally:
    """Counts of the events of one shard, added up from rows."""

    #: Entries that wait before equal ones are added up.
    WAITING = 1 << 22

    def __init__(self, kind: int):
        self.kind = kind
        self.words: defaultdict[bytes, int] = defaultdict(int)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, raw_keys: bytes, counts: np.ndarray) -> None:
        keys = unpack_keys(self.kind, raw_keys)
        if self.kind == WORDS:
            own = self.words
            for w, n in zip(keys, counts.tolist(), strict=True):
                if n:
                    own[w] += n
            return
        self.parts.append((keys[counts > 0], counts[counts > 0]))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > self.WAITING:
            self._settle()

    def _settle(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.waiting = [ppm.summed(keys, counts)], 0

    def entries(self) -> tuple:
        if self.kind == WORDS:
            return list(self.words), np.array(list(self.words.values()), np.int64)
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._settle()
        return self.parts[0]


def _add_up(*by: str) -> Callable[[Batches], Batches]:
    """Sum the counts of runs of rows that are equal in ``by``."""

    def run(batches: Batches) -> Batches:
        now, tally = None, None

        def made():
            keys, counts = tally.entries()
            if len(counts):
                own = pack_keys(tally.kind, keys), pack_numbers(counts.astype("<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in own)],
                    ["kind", "shard", "keys", "counts"],
                )

        for batch in batches:
            columns = [batch.column(c) for c in (*by, "keys", "counts")]
            for row in zip(*columns, strict=True):
                *key, raw, counts = (x.as_py() for x in row)
                if key != now:
                    if tally:
                        yield from made()
                    now, tally = key, Tally(key[0])
                tally.add(raw, unpack_numbers(counts, "<i8"))
        if tally:
            yield from made()

    return run


def _streamed(rows: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows), *keys).sortWithinPartitions(*keys, *then)


def learn(rows: DataFrame) -> DataFrame:
    """(kind, shard, keys, counts): the training counts, one row for each shard."""
    own = rows.filter(F.col("kind") > TEXTS).withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(_parts(rows))))
    some = _streamed(own.select("kind", "shard", "part", "keys", "counts"), "kind", "shard", "part")
    some = some.mapInArrow(_add_up("kind", "shard", "part"), COUNTS)
    return _streamed(some, "kind", "shard").mapInArrow(_add_up("kind", "shard"), COUNTS)


def _parts(rows: DataFrame) -> int:
    return max(1, rows.filter(F.col("kind") == TEXTS).count() // MERGED)


def _pairs(counts: DataFrame, order: int) -> np.ndarray:
    """What the contexts of one byte count, added up over the shards."""

    def run(batches: Batches) -> Batches:
        total = np.zeros((256, 256), np.int64)
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                total += ppm.pair_counts(unpack_keys(SYMBOLS, keys), order)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total.ravel()[pair])], ["pair", "n"])

    rows = counts.filter(F.col("kind") == SYMBOLS).select("keys").mapInArrow(run, "pair int, n long")
    out = np.zeros(1 << 16, np.int64)
    for pair, n in rows.groupBy("pair").agg(F.sum("n")).collect():  # 65,536 rows at most
        out[pair] = n
    return out.reshape(256, 256)


def _totals(counts: DataFrame) -> tuple[int, int]:
    """The number of all training tokens, and of the different ones."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sums = [unpack_numbers(x, "<i8") for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x.sum()) for x in sums], pa.int64()), pa.array([len(x) for x in sums], pa.int64())], ["n", "v"]
            )

    row = counts.filter(F.col("kind") == WORDS).select("counts").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


def _answered(shared, order: int):
    """Values of the keys of each row from the counts that come before it."""

    def run(batches: Batches) -> Batches:
        now, model = None, None
        for batch in batches:
            out = []
            for kind, shard, part, number, keys, counts in zip(
                *(batch.column(c) for c in ("kind", "shard", "part", "batch", "keys", "counts")), strict=True
            ):
                kind, key = kind.as_py(), (kind.as_py(), shard.as_py(), part.as_py())
                if key != now:
                    now, model = key, None
                raw, number = keys.as_py(), number.as_py()
                if number is None:
                    own = unpack_keys(kind, raw), unpack_numbers(counts.as_py(), "<i8")
                    if kind == WORDS:
                        model = dict(zip(own[0], own[1].tolist(), strict=True))
                    else:
                        model = ppm.Trie(*own, order, shared.value)
                    continue
                wanted = unpack_keys(kind, raw)
                if kind == WORDS:
                    known = model or {}
                    values = np.fromiter((known.get(w, 0) for w in wanted), VALUES[kind], len(wanted))
                else:
                    model = model or ppm.Trie(wanted[:0], np.zeros(0, np.int64), order, shared.value)
                    values = model.log10(wanted).astype(VALUES[kind])
                out.append((number, kind, key[1], pack_numbers(values)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["batch", "kind", "shard", "found"]
            )

    return run


def answers(rows: DataFrame, counts: DataFrame, pairs: np.ndarray, order: int, asked: int = ASKED) -> DataFrame:
    """(batch, kind, shard, found): for the keys of each row their log
    probabilities, or counts of words, in the same order."""
    own = rows.filter(F.col("kind") > TEXTS).select("kind", "shard", "batch", "n", "keys")
    # one row for each of at most 65,536 shards
    spread = own.groupBy("kind", "shard").agg(F.ceil(F.sum("n") / F.lit(asked)).cast("int").alias("parts"))
    spread = F.broadcast(stored(spread, "spread"))
    asking = own.join(spread, ["kind", "shard"]).select(
        "kind", "shard", F.pmod(F.xxhash64("batch"), "parts").cast("int").alias("part"), "batch", "keys",
        F.lit(None).cast("binary").alias("counts"),
    )
    known = counts.join(spread, ["kind", "shard"]).select(
        "kind", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("batch"), "keys", "counts",
    )
    met = _streamed(known.union(asking), "kind", "shard", "part", then=("batch",))  # the counts have no batch: first
    shared = rows.sparkSession.sparkContext.broadcast(pairs)  # 256 by 256
    return met.mapInArrow(_answered(shared, order), "batch long, kind int, shard int, found binary")


def _scores(shard_bits: int, order: int, n_tokens: int, n_words: int):
    def scored(row: dict, found: dict[int, list[bytes]]) -> pa.RecordBatch:
        texts = zstandard.decompress(row["keys"]).split(b"\n")
        events = Events(texts, shard_bits, order)
        logs, counts = (np.concatenate([unpack_numbers(x, VALUES[k]) for x in found[k]]) for k in (SYMBOLS, WORDS))
        base = np.log10((counts + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(row["held"], pa.bool_()),
                pa.array(events.word_counts),
                pa.array(events.by_word((counts > 0).astype(np.int64))),
                pa.array(np.full(n, n_tokens, np.int64)),
                pa.array(events.by_word(base)),
                pa.array(events.by_symbol(logs.astype(float))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Batches) -> Batches:
        row, found = None, {}
        for batch in batches:
            for one in range(batch.num_rows):
                now = batch.slice(one, 1).to_pylist()[0]
                if now["kind"] == TEXTS:
                    if row:
                        yield scored(row, found)
                    row, found = now, {SYMBOLS: [], WORDS: []}
                else:
                    found[now["kind"]].append(now["found"])
        if row:
            yield scored(row, found)

    return run


def score_texts(
    docs: DataFrame,
    order: int = ppm.ORDER,
    batch_bytes: int = BATCH_BYTES,
    shard_bytes: int = SHARD_BYTES,
    asked: int = ASKED,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row. ``score`` is the model's log10 probability of the text; ``base_score``
    that of its tokens one by one, each with 0.1 added to its count."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bits = min(16, max(3, (size // shard_bytes).bit_length()))
    path = run_folder(spark, "events")
    texts.mapInArrow(_packed(shard_bits, order, batch_bytes), ROWS).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(ROWS).parquet(path)
    counts = stored(learn(rows), "counts")
    found = answers(rows, counts, _pairs(counts, order), order, asked)
    whole = rows.filter(F.col("kind") == TEXTS).select(
        "batch", "kind", "shard", F.lit(None).cast("binary").alias("found"), "keys", "ids", "held"
    )
    back = found.select(
        "batch", "kind", "shard", "found",
        F.lit(None).cast("binary").alias("keys"),
        F.lit(None).cast("array<long>").alias("ids"),
        F.lit(None).cast("array<boolean>").alias("held"),
    )
    met = _streamed(whole.union(back), "batch", then=("kind", "shard"))
    return met.mapInArrow(
        _scores(shard_bits, order, *_totals(counts)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
