import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmuration.llm.components import components
from murmuration.llm.gray_index import GrayIndex, gray_rank, linked
from murmuration.llm.queries import op2_simhash_gray
from murmuration.llm.simhash import _links, fingerprint, links, near_duplicates


def distances(a, b):
    return np.bitwise_count(a[:, None] ^ b[None, :])


def closure(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(x) for x in range(n)]


def clustered(rng, n, centres=5, flips=4):
    base = rng.integers(0, 2**64, centres, dtype=np.uint64)
    codes = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        codes = codes ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(codes)


def test_gray_rank_orders_the_gray_sequence():
    numbers = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(numbers ^ (numbers >> np.uint64(1))) == numbers).all()


@pytest.mark.parametrize("n,radius", [(1, 2), (7, 0), (9, 2), (300, 2), (1500, 3)])
def test_search_equals_brute_force(n, radius):
    codes = clustered(np.random.default_rng(n), n)
    q, at = GrayIndex(codes).search(codes, radius)
    want = np.argwhere(distances(codes, codes) <= radius)
    assert sorted(zip(q, at, strict=True)) == [tuple(x) for x in want]


def test_linked_equals_closure():
    codes = clustered(np.random.default_rng(3), 900)
    want = closure(len(codes), np.argwhere(distances(codes, codes) <= 2))
    assert linked(codes, 2, block=64).tolist() == want


@pytest.mark.parametrize("hot,bucket", [(3, 10), (4096, 1 << 14), (4096, 7)])
def test_links_join_what_pairs_join(spark, hot, bucket):
    codes = clustered(np.random.default_rng(8), 400, flips=5)
    signed = codes.view(np.int64).tolist()
    at = {c: k for k, c in enumerate(signed)}
    got = links(spark.createDataFrame([(c,) for c in signed], "code bigint"), hot=hot, bucket=bucket).collect()
    want = closure(len(codes), np.argwhere(distances(codes, codes) <= 2))
    assert closure(len(codes), [(at[r.a], at[r.b]) for r in got]) == want


def test_every_link_leaves_the_gray_index(spark, monkeypatch):
    """All fingerprints of sf0.1 as one bucket: what joins them are answers of the index."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()
    codes = np.unique(np.array([fingerprint(r.text) for r in rows], np.uint64))
    answers, plain = set(), GrayIndex.search

    def counted(self, queries, radius, *more):
        q, at = plain(self, queries, radius, *more)
        answers.update(zip(queries[q].view(np.int64).tolist(), own[at].tolist(), strict=True))
        return q, at

    monkeypatch.setattr(GrayIndex, "search", counted)
    signed = np.sort(codes.view(np.int64))
    own = signed
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int64)), pa.array(p)], ["bucket", "code"]) for p in np.array_split(signed, 3)]
    found = [(a, b) for batch in _links(2)(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    place = {c: k for k, c in enumerate(signed.tolist())}
    label = closure(len(signed), [(place[a], place[b]) for a, b in found])
    assert label == closure(len(signed), [(place[a], place[b]) for a, b in answers])
    near = np.argwhere(distances(signed.view(np.uint64), signed.view(np.uint64)) <= 2)
    assert label == closure(len(signed), near) and len(answers) > 0 < len(found)


def test_hot_keys_are_cut_again(spark):
    """A dense group, radius 6 of 64 bits in 8 parts, at most 20 to a key."""
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 9, 60).astype(np.uint64) << np.uint64(20))
    signed = codes.view(np.int64).tolist()
    got = links(spark.createDataFrame([(c,) for c in signed], "code bigint"), 6, 8, hot=20, bucket=50).collect()
    place = {c: k for k, c in enumerate(signed)}
    assert len(set(closure(len(signed), [(place[r.a], place[r.b]) for r in got]))) == 1


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(900, 1000)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 900 for k in range(900, 1001)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jvm_hash_agrees(spark):
    """A text of at most three words is one shingle: Spark's own hash, seed 42."""
    for text in ("one", "one two", "a é ñ"):
        row = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()
        assert fingerprint(text.upper().replace("É", "é").replace("Ñ", "ñ")) == row.h % 2**64
    assert fingerprint("") == fingerprint(None) == fingerprint(" \t\n") == 0
    assert fingerprint("a  b\x0bC d") == fingerprint("a b c d")
    assert fingerprint("a\xa0b") != fingerprint("a b")


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    codes = np.array([fingerprint(d.text) for d in docs], np.uint64)
    want = closure(len(docs), np.argwhere(distances(codes, codes) <= 2))
    got = op2_simhash_gray(spark, folder).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{c:016x}" for c in codes]
    assert [r.component_id for r in got] == [docs[k].doc_id for k in want]


def test_null_empty_and_repeated_rows(make_docs):
    docs = make_docs([(7, None), (3, ""), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "alone here now")])
    docs = docs.withColumn("code", F.lit("mine")).withColumn("node", F.lit(1))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == [("3", "3"), ("7", "3"), ("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")]
    assert near_duplicates(docs.limit(0)).count() == 0
