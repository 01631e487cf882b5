import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from murmuration.llm.cuckoo import CuckooFilter
from murmuration.llm.line_dedup import BLANKS, LineIndex, dedup_lines, index_lines
from murmuration.llm.queries import ORACLE, QUERIES

LONG = "a line of more than twenty points"


def brute(rows, min_docs=3):
    holders = defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        bare = line.strip(BLANKS).translate(lower)
        return bare if len(bare) >= 20 else None

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and key(line):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if doc is None or key(x) is None or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**64, (2, max(n, 1)), dtype=np.uint64)
    keys = keys[:n]
    cuckoo = CuckooFilter.for_keys(n)
    assert cuckoo.insert(keys) and cuckoo.contains(keys).all()
    assert cuckoo.contains(others).mean() < 0.01
    cuckoo = CuckooFilter.from_bytes(cuckoo.to_bytes())
    cuckoo.delete(keys[: n // 2])
    assert cuckoo.contains(keys[n // 2 :]).all()
    cuckoo.delete(keys[n // 2 :])
    assert not cuckoo.table.any()


def test_a_full_filter_says_so():
    cuckoo = CuckooFilter(2)
    assert not cuckoo.insert(np.arange(1, 40, dtype=np.uint64))


ROWS = [
    (1, f"{LONG}\nshort\n{LONG}"),
    (2, f"  {LONG.upper()}\t\nown words of document two, once"),
    (3, f"{LONG}\r\n\n"),
    (3, f"{LONG}\nanother row of document three"),
    (4, None),
    (5, ""),
    (None, LONG),
    (6, "é" * 20 + "\nx"),
    (7, "é" * 20),
    (8, "É" * 20),
    (9, "é" * 20 + "\n\xa0" + LONG),
    (10, LONG + " " * 50_000 + "\n" + LONG),
]


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_equals_brute_force(make_docs):
    docs = make_docs(ROWS).withColumn("keys", F.lit("mine")).withColumn("shard", F.lit(0))
    assert rows_of(dedup_lines(docs)) == sorted(brute(ROWS), key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, folder):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = QUERIES["op4_line_dedup"](spark, folder).toPandas()
    assert compare(got, db.execute(ORACLE["op4_line_dedup"]).df()) == "ok"
    assert got.n_dropped.sum() > 0
    doc = spark.read.parquet(f"{folder}/documents.parquet").first()
    row = got[got.doc_id == doc.doc_id].iloc[0]
    assert row.n_dropped or row.kept_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def state(index: LineIndex):
    counts = sorted((bytes(r.key), r.n_docs, r.max_doc) for r in index.counts.collect())
    filters = {r.shard: (CuckooFilter.from_bytes(r.cuckoo), r.n_keys) for r in index.filters.collect()}
    for r in index.counts.collect():
        assert filters[r.shard][0].contains(np.frombuffer(r.key, "<u8")[1:]).all()
    assert sum(n for _, n in filters.values()) == len(counts)
    return counts, sum(int((f.table > 0).sum()) for f, _ in filters.values())


def test_deletion_undoes_insertion(make_docs):
    first, second = ROWS[:3], [(20, LONG), (21, f"{LONG}\nnew words that nobody else has"), (0, "é" * 21)]
    index = index_lines(make_docs(first), shards=3)
    before = state(index)
    both = index.insert(make_docs(second))
    everything = make_docs(first + second)
    assert state(both) == state(index_lines(everything, shards=3))
    assert rows_of(dedup_lines(everything, both)) == sorted(brute(first + second), key=str)
    again = both.delete(make_docs(second))
    assert state(again) == before
    largest = both.delete(make_docs([(21, None)]))  # the largest holder goes: the line stays in document 20
    left = [r for r in first + second if r[0] != 21]
    assert rows_of(dedup_lines(make_docs(left), largest)) == sorted(brute(left), key=str)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_insertion_in_parts_asks_the_filters(make_docs, parts):
    index = index_lines(make_docs(ROWS), shards=3, parts=parts)
    assert state(index) == state(index_lines(make_docs(ROWS), shards=3, parts=1))
    assert rows_of(dedup_lines(make_docs(ROWS), index)) == sorted(brute(ROWS), key=str)


def test_a_document_is_not_inserted_twice(make_docs):
    index = index_lines(make_docs(ROWS), shards=2)
    with pytest.raises(ValueError, match="already holds document 2"):
        index.insert(make_docs([(99, LONG), (2, LONG)]))
    back = index.delete(make_docs([(2, None)])).insert(make_docs([ROWS[1]]))
    assert state(back) == state(index)
