"""The best documents of each query item by term weights, through document trees.

Items are taken in blocks of bounded vocabulary. Documents are read once per
block and reduced to their terms of the block (``vectors``), which are written;
counts over all documents give the weights. A second pass over the vectors
builds trees of a bounded number of documents each (``fp_tree``) and searches
every item in every tree; what an item has found in one tree of a task bounds
its search in the next. A task hands on at most k documents an item, which are
ranked in two steps.

Terms are the runs of digits, letters and characters beyond ASCII of the whole
text, A-Z in lower case. A null or empty text has no terms: such a document
counts nowhere and is never found, such an item finds nothing. Rows that repeat
an id, and rows without one, are documents (or items) of their own; equal scores
go by ascending id, none first. Very long texts are taken whole. Without
documents or items the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from murmuration.llm.common import Batches, map_rows, stored, text_of
from murmuration.llm.decontaminate import words_of as terms_of
from murmuration.llm.fp_tree import NO_ID, Best, DocumentTree

K = 10
#: Distinct terms of a block of items; an item of more is a block of its own.
BLOCK_TERMS = 8192
#: Documents and entries of a tree; a document of more is a tree of its own.
TREE_DOCS = 8192
TREE_ENTRIES = 1 << 21
#: Lists of one item are first merged in so many parts.
MERGE = 32


@dataclass
class ItemBlock:
    """Items by number: their ids and their terms with repeats; the terms' ids."""

    numbers: list[int] = field(default_factory=list)
    ids: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[ItemBlock]:
    now = ItemBlock()
    for number, row in enumerate(items.select("item_id", text_of()).toLocalIterator()):
        counts = Counter(terms_of(row.text))
        if not counts:
            continue
        if now.ids and len(now.terms) + sum(t not in now.terms for t in counts) > block_terms:
            yield now
            now = ItemBlock()
        now.numbers.append(number)
        now.ids.append(row.item_id)
        now.counts.append(Counter({now.terms.setdefault(t, len(now.terms)): n for t, n in counts.items()}))
    if now.ids:
        yield now


def vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms, and those asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of bounded size

    def columns(batch: pa.RecordBatch) -> dict:
        known = shared.value
        n, own, tfs = [], [], []
        for text in batch.column("text").to_pylist():
            words = terms_of(text)
            n.append(len(words))
            counts = Counter(filter(None.__ne__, map(known.get, words)))
            own.append(list(counts.keys()))
            tfs.append(list(counts.values()))
        return {"doc_id": batch.column("doc_id"), "n": n, "terms": own, "tfs": tfs}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return map_rows(rows, "doc_id long,n long,terms array<int>,tfs array<int>", columns)


@dataclass
class Weights:
    """What the search needs of the whole corpus: weights and frequency ranks."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    rank: np.ndarray

    @staticmethod
    def of(rows: DataFrame, n_terms: int) -> Weights:
        total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(n_terms, np.int64)
        # one row per term of the block, whose number is bounded
        for term, count in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = count
        n = total[0]
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
        rank = np.empty(n_terms, np.int64)
        rank[np.lexsort((np.arange(n_terms), -df))] = np.arange(n_terms)
        return Weights(n, total[1] or 0, np.array(weight, np.int64), rank)


def _tree(rows: list[tuple], weights: Weights) -> DocumentTree:
    """A tree of rows (doc_id, n, terms, tfs) as arrays."""
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    terms = weights.rank[np.concatenate([r[2] for r in rows])]
    order = np.lexsort((terms, np.repeat(np.arange(len(rows)), sizes)))
    tf = np.concatenate([r[3] for r in rows])[order]
    # plain integers: the product may pass 64 bits
    m = [25 + 75 * r[1] * weights.n_docs // weights.n_terms for r in rows]
    ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
    return DocumentTree(first, terms[order], tf, np.array(m, np.int64), ids, len(weights.rank))


def _search(shared, k: int, tree_docs: int, tree_entries: int, schema: pa.Schema):
    def trees(batches: Batches, weights: Weights) -> Iterator[DocumentTree]:
        rows, entries = [], 0
        for batch in batches:
            lists = [batch.column(c) for c in ("terms", "tfs")]
            sides = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy() for x in lists]
            for i, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                own = tuple(v[s[i] : s[i + 1]] for v, s in zip(flat, sides, strict=True))
                if not len(own[0]):
                    continue
                if rows and (len(rows) >= tree_docs or entries + len(own[0]) > tree_entries):
                    yield _tree(rows, weights)
                    rows, entries = [], 0
                rows.append((doc, n, *own))
                entries += len(own[0])
        if rows:
            yield _tree(rows, weights)

    def run(batches: Batches) -> Batches:
        block, weights = shared.value
        queries = []
        for counts in block.counts:
            terms = np.array(sorted(counts), np.int64)
            times = np.array([counts[t] for t in terms.tolist()], np.int64)
            queries.append((weights.rank[terms], weights.weight[terms] * times, Best(k)))
        for tree in trees(batches, weights):
            for query in queries:
                tree.search(*query)
        task = TaskContext.get().partitionId() % MERGE
        out = [
            (number, item, task, None if doc == NO_ID else doc, -score)
            for number, item, (_, _, best) in zip(block.numbers, block.ids, queries, strict=True)
            for score, doc in best.rows
        ]
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    block_terms: int = BLOCK_TERMS,
    tree_docs: int = TREE_DOCS,
    tree_entries: int = TREE_ENTRIES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with
    a score above 0, ranked from 1."""
    spark = docs.sparkSession
    spec = T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in spec])
    found = spark.createDataFrame([], spec)
    for block in item_blocks(items, block_terms):
        rows = stored(vectors(docs, block.terms), "vectors")
        weights = Weights.of(rows, len(block.terms))
        if not weights.n_terms:
            break
        shared = spark.sparkContext.broadcast((block, weights))
        found = found.union(rows.mapInArrow(_search(shared, k, tree_docs, tree_entries, schema), spec))
    order = F.desc("score"), F.asc_nulls_first("doc_id")
    for keys in (["item", "part"], ["item"]):  # an item's lists meet in two steps
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
