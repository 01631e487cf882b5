"""Passages of benchmark items in documents, by a suffix automaton of the items.

The items go into automata of at most ``BLOCK_WORDS`` words each, which is what
is broadcast at a time. Documents stream past where they are read: words that
no item has break the text into runs, and only runs as long as the shortest
window are matched. At every word the automaton gives the length of the longest
passage ending there; where that reaches the window, its items are looked up.

Words: letters A-Z count as a-z; words are runs of digits, such letters and all
characters beyond ASCII. A window is ``window`` consecutive words of an item, or
a whole shorter item. Items without words have none. A null text has no words.
Rows that repeat an id, and rows without, are documents of their own. Other
columns are ignored. Empty tables have empty results, or no hits; very long texts
are matched whole.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from murmuration.llm.automaton import SuffixAutomaton
from murmuration.llm.common import Batches, pieces, spread, stored, text_of

WINDOW = 10
#: Share of a document's words beyond which it goes as a whole.
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000
#: A word in a text whose letters A-Z are as they were.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_SPACE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MATCHES = "doc_id bigint, text string, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACE).split()


class Items:
    """Benchmark items: their words, automaton, and the items of each window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.windows: defaultdict[int, defaultdict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        self.n_words = 0

    def add(self, item_id, text: str | None) -> None:
        words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
        if not words:
            return
        self.automaton.add(words)
        self.n_words += len(words)
        size = min(self.window, len(words))
        for k in range(len(words) - size + 1):
            self.windows[size][tuple(words[k : k + size])].add(item_id)

    def plain(self) -> bytes:
        self.windows = {n: dict(w) for n, w in self.windows.items()}
        return pickle.dumps(self)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words, and the items whose windows occur."""
        if not self.windows or not words:
            return [], set()
        get = self.ids.get
        symbols = [get(w, -1) for w in words]
        known = np.array(symbols) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        firsts, lasts = edges[::2], edges[1::2]
        long = lasts - firsts >= min(self.windows)
        runs: list[tuple[int, int]] = []
        items: set = set()
        for first, last in zip(firsts[long].tolist(), lasts[long].tolist(), strict=True):
            part = symbols[first:last]
            spans = []
            for k, size in enumerate(self.automaton.matching(part), 1):
                for n, windows in self.windows.items():
                    if size >= n and (who := windows.get(tuple(part[k - n : k]))):
                        items |= who
                        spans.append((first + k - n, first + k))
            runs.extend(merged(spans))
        return runs, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[bytes]:
    """The items in blocks of bounded size, one after the other."""
    now = Items(window)
    for row in benchmark.select(F.col("item_id"), text_of()).toLocalIterator():
        now.add(row.item_id, row.text)
        if now.n_words >= block_words:
            yield now.plain()
            now = Items(window)
    yield now.plain()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string()))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "starts", "ends", "items"])


def _found(shared):
    def run(batches: Batches) -> Batches:
        items = pickle.loads(shared.value)
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                runs, who = items.find(words)
                rows.append((doc, text, len(words), [a for a, _ in runs], [b for _, b in runs], sorted(map(str, who))))
            yield _batch(rows)

    return run


def _joined(batches: Batches) -> Batches:
    """Merge what the blocks of items found in a document."""
    for batch in pieces(batches):
        rows = []
        for r in batch.to_pylist():
            spans = merged([s for part in r["spans"] for s in zip(part["starts"], part["ends"], strict=True)])
            items = sorted({i for part in r["spans"] for i in part["items"]})
            for _ in range(r["copies"]):
                rows.append((r["doc_id"], r["text"], r["n_words"], [a for a, _ in spans], [b for _, b in spans], items))
        yield _batch(rows)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, text, n_words, starts, ends, items): every row of ``docs`` with
    its runs of hit words, by word number, and the ids of the items, as strings
    in order."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    found = [
        rows.mapInArrow(_found(spark.sparkContext.broadcast(block)), MATCHES)
        for block in item_blocks(benchmark, window, block_words)
    ]
    if len(found) == 1:
        return found[0]
    # a benchmark of several blocks: one pass each, met by document and text
    every = stored(found[0], "passages")
    for more in found[1:]:
        every = every.union(stored(more, "passages"))
    spans = F.collect_list(F.struct("starts", "ends", "items")).alias("spans")
    copies = (F.count(F.lit(1)) / len(found)).cast("int").alias("copies")
    keyed = every.withColumn("digest", F.sha2("text", 256))
    grouped = spread(keyed, "doc_id", "digest").groupBy("doc_id", "digest")
    one = grouped.agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), spans, copies)
    return one.mapInArrow(_joined, MATCHES)


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def without_spans(text: str, starts: list[int], ends: list[int], min_words: int) -> str:
    """The text without the runs of hit words that reach ``min_words``."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        if b - a >= min_words:
            out.append(text[at : words[a][0]])
            at = words[b - 1][1]
    return "".join([*out, text[at:]])


def clean_texts(found: DataFrame, min_words: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(doc_id, text): texts without the passages of at least ``min_words`` words.
    A document of which more than ``max_coverage`` is hit goes as a whole."""

    def run(batches: Batches) -> Batches:
        for batch in pieces(batches):
            docs, texts = [], []
            for r in batch.to_pylist():
                hit = sum(r["ends"]) - sum(r["starts"])
                if hit <= max_coverage * r["n_words"]:
                    docs.append(r["doc_id"])
                    texts.append(without_spans(r["text"], r["starts"], r["ends"], min_words) if hit else r["text"])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(run, "doc_id bigint, text string")



def cut_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_words: int = 1,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the runs of hit words
    (of ``window`` words at least, or a whole shorter item) that reach ``min_words``;
    a row of whose words more than ``max_coverage`` are hit goes. Texts without a hit stay as they
    are, null ones too; ``n_chars``, where it is a column, follows a text that was
    cut. What several blocks of items find is written in between, so that no task
    holds more than one block. The name _hits is reserved."""
    spark, names = docs.sparkSession, docs.columns
    at, counted = names.index("text"), "n_chars" in names
    if "_hits" in names:
        raise ValueError("the input already has the column _hits")
    flat = pa.list_(pa.int64())
    with_hits = T.StructType([*docs.schema.fields, T.StructField("_hits", T.ArrayType(T.LongType()))])

    def cut(batch: pa.RecordBatch, texts: list, hits: list) -> pa.RecordBatch:
        """The rows that stay, in the input's columns, their texts cut."""
        stay, sizes = [], batch.column("n_chars").to_pylist() if counted else [None] * len(texts)
        for k, flat_runs in enumerate(hits):
            runs = merged(list(zip(flat_runs[::2], flat_runs[1::2], strict=True)))
            n = sum(b - a for a, b in runs)
            stay.append(n == 0 or n <= max_coverage * len(words_of(texts[k])))
            if n and stay[-1]:
                texts[k] = without_spans(texts[k], *zip(*runs, strict=True), min_words)
                sizes[k] = len(texts[k])
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        columns["text"] = pa.array(texts, pa.string())
        if counted:
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(stay))

    def finder(block: bytes, last: bool):
        shared = spark.sparkContext.broadcast(block)  # of bounded size

        def find(batches: Batches) -> Batches:
            items = pickle.loads(shared.value)
            for batch in pieces(batches):
                texts, before = batch.column(at).to_pylist(), batch.column("_hits").to_pylist()
                hits = [old + [x for run in items.find(words_of(t))[0] for x in run] for t, old in zip(texts, before, strict=True)]
                if last:
                    yield cut(batch, texts, hits)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, flat)], batch.schema.names)

        return find

    # the pass of the last block also cuts: a task has one Python worker, and texts go to it once
    rows = docs.withColumn("_hits", F.array().cast("array<long>"))
    blocks = item_blocks(benchmark, window, block_words)
    block = next(blocks)
    for following in blocks:
        rows = stored(rows.mapInArrow(finder(block, False), with_hits), "hits")
        block = following
    return rows.mapInArrow(finder(block, True), docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of an item occurs.

    One pass over the texts for each block of items, in the rows' own order."""
    at = docs.columns.index("text")
    rows = docs
    for block in item_blocks(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size

        def run(batches: Batches, shared=shared) -> Batches:
            items = pickle.loads(shared.value)
            for batch in pieces(batches):
                hit = [bool(items.find(words_of(t))[0]) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not h for h in hit]))

        rows = rows.mapInArrow(run, docs.schema)
    return rows
