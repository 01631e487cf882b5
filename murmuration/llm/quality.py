"""Document quality by boosted trees over statistics of the whole text.

The trees are fitted on at most ``MAX_ROWS`` labelled documents outside the
held-out fold (those with the smallest hash of the id; a documented bound on
what the driver receives: that many rows of a few dozen numbers). Scoring is a
pass over the documents where they are read. Labels, language, source and id are
never inputs.

Null and empty texts have statistics of zero and a score like any other. Labels
that are null do not count; a document labelled several times is good if any
label says so. Without labels of both kinds the score is constant. Rows that
repeat an id, or have none, are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm import boosting
from murmuration.llm.common import held_out, is_held_out, map_rows, pieces, text_of

MAX_ROWS = 20_000
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(
    (
        b"abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" ",
        b"\n",
        b"\t\r\x0b\x0c",
        b".,;:!?",
        b"'\"()-",
        b"#$%&*+=@^~|<>/\\_[]{}`",
    ),
    1,
):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 10
KINDS = 11


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SIGN = np.isin(_KIND, (0, 8, 9))
_STOP = np.isin(np.arange(256), list(b".!?"))
_LONE = np.isin(np.arange(256), list(b"|-*#"))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND, np.bincount(data, minlength=256), KINDS)
    size = max(len(raw), 1)
    # words by their first and last bytes
    blank = np.concatenate(([True], _BLANK[data], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    firsts, lasts = data[edges[::2]], data[edges[1::2] - 1]
    words = raw.split()
    n = max(len(words), 1)
    lengths = edges[1::2] - edges[::2] if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    signs = int(_SIGN[lasts].sum())
    stops = int(_STOP[lasts].sum())
    capitals = int((_KIND[firsts] == 2).sum())
    lone = int((_LONE[firsts] & (edges[1::2] - edges[::2] == 1)).sum())
    lines = raw.split(b"\n")
    distinct_lines = len(set(lines))
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        *(kinds / size),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        float((lengths <= 2).mean()),
        float((lengths >= 12).mean()),
        len(counts) / n,
        len(counts) / math.sqrt(n),
        top / n,
        repeats / n,
        signs / n,
        stops / n,
        capitals / n,
        lone / n,
        distinct_lines / len(lines),
        float(line_sizes.mean()),
        float(line_sizes.max()),
        float((line_sizes < 20).mean()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def columns(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "x": [statistics(t) for t in batch.column("text").to_pylist()],
        }

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()), "doc_id long,x array<double>", columns)


def training_ids(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, y): the labelled documents to learn from, ``max_rows`` at most."""
    usable = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> boosting.Trees:
    chosen = F.broadcast(training_ids(labels, "quality", max_rows))  # max_rows rows at most
    found = features(docs.join(chosen, "doc_id", "left_semi"))
    # of documents that repeat an id the one with the least statistics: a row per id
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id").collect()
    # sorted, so that the trees do not depend on partitioning
    rows = sorted((r.doc_id, tuple(r.x), r.y) for r in rows)
    x = np.array([r[1] for r in rows], float).reshape(len(rows), len(statistics(None)))
    return boosting.fit(x, np.array([r[2] for r in rows], float), **settings)


def score_quality(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees

    def columns(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id")
        texts = batch.column("text").to_pylist()
        score = shared.value.score(np.array([statistics(t) for t in texts]))
        return {
            "doc_id": ids,
            "held_out": [is_held_out(i) for i in ids.to_pylist()],
            "score": score,
            "predicted": (score >= threshold).astype(np.int32),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return map_rows(rows, "doc_id long,held_out boolean,score double,predicted int", columns)


def keep_good(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in pieces(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
