import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm.multi_index import Codebooks, cells_in_order, codes_for, cosine, fit, nearest, shards_of, usable
from murmuration.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(i, set()).add(tuple(np.float32(v).astype(float)))
    out = {}
    for q in fine:
        if q % every == 0:
            a = np.array(max(fine[q]))
            own = {i: [v for v in vs if len(v) == len(a)] for i, vs in fine.items() if i != q}
            scores = {i: max(float(cosine(a[None], np.array(v)[None])[0]) for v in vs) for i, vs in own.items() if vs}
            out[q] = sorted(((-s, i) for i, s in scores.items()))[:k]
    return {q: [(i, -s) for s, i in best] for q, best in out.items()}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    order = list(cells_in_order(a, b))
    assert len(set(order)) == 35
    assert np.all(np.diff([a[i] + b[j] for i, j in order]) >= 0)


def test_shards_are_bounded():
    counts = np.array([3, 0, 10, 4, 4, 4, 25, 1])
    first, parts = shards_of(counts, 8)
    load = np.zeros(int((first + parts).max()))
    for n, f, p in zip(counts, first, parts, strict=True):
        load[f : f + p] += n / p
    assert load.max() <= 8 and parts.tolist() == [1, 1, 2, 1, 1, 1, 4, 1]


@pytest.mark.parametrize("share,size", [(1.0, 6), (1.0, 1)])
def test_full_visits_equal_brute_force(spark, share, size):
    rng = np.random.default_rng(size)
    rows = [(k, rng.normal(size=size).round(1).tolist()) for k in range(130)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # a crowd of copies, with ties
    rows += [(50_000, [2 * x for x in rows[3][1]]), (60, rows[50][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for few in (0, 1000):
        assert got(nearest(df, share=share, codes=4, shard_rows=20, few=few)) == brute(rows)


def test_vectors_of_every_length_are_asked_and_found(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=[2, 3, 5][k % 3]).tolist()) for k in range(600)]
    rows += [(6000, [1.0]), (6050, [-2.0]), (6100, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = brute(rows)
    for few in (50, 10_000):
        assert got(nearest(df, share=1.0, shard_rows=60, few=few)) == {q: best for q, best in want.items() if best}
    assert {len(best) for best in want.values()} == {0, 1, 5}


@pytest.mark.parametrize("n", [20_000])
def test_recall_on_many_vectors(spark, n):
    """Clustered vectors, searched with the share that the sample asks for."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)
    have = got(nearest(df, every=200))
    asked = np.arange(0, n, 200)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    true = np.argsort(-near, axis=1)[:, :5]
    found = sum(len({i for i, _ in have[q]} & set(t)) for q, t in zip(asked.tolist(), true.tolist(), strict=True))
    assert found >= 0.9 * 5 * len(asked)
    space = fit(usable(df))[16]
    assert space.share < 0.5 and space.books.codes == codes_for(n)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.5, -1.0]), (100, [0.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    df = df.withColumn("v", F.lit("mine")).withColumn("cell", F.lit(1)).withColumn("ids", F.lit(1))
    assert got(nearest(df)) == brute(rows)
    odd = df.union(spark.createDataFrame([(8, [1.0, 2.0, 3.0], 0)], SCHEMA).select("*", F.lit(""), F.lit(1), F.lit(1)))
    assert got(nearest(odd)) == brute(rows)
    assert nearest(df.limit(0)).count() == 0
    assert got(nearest(df.filter("vec_id = 0"))) == {}


def test_codebooks_of_few_vectors():
    books = Codebooks(np.ones((3, 4)), 4)
    assert books.cells(np.ones((2, 4))).tolist() == [0, 0]


def test_recall_of_the_query(spark, folder):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, have = brute(rows), got(QUERIES["op3_multi_index"](spark, folder))
    assert want.keys() == have.keys() and all(len(have[q]) == 5 for q in want)
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert found >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact.get((q, i), s) - s) < 1e-15 for q in have for i, s in have[q])
