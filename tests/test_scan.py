import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import scan, sorting
from murmuration.operators.scan import MAX_BUCKETS, MAX_WIDTH, bucket_width, lay_out, prefix_sum


def vector(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id bigint, v bigint").repartition(parts)


def grouped(spark, rows, parts=3):
    return spark.createDataFrame(rows, "g string, id bigint, v bigint").repartition(parts)


def running(rows):
    total, out = 0, {}
    for i, v in sorted(rows):
        total += v
        out[i] = total
    return out


SPARSE = [-(10**15), -7, 0, 3, 10**6, 10**12, 2**60]


@pytest.mark.parametrize("layout", ["auto", "range"])
def test_sparse_and_negative_ids(spark, layout):
    rows = [(i, k + 1) for k, i in enumerate(SPARSE)]
    got = scan.prefix_sum(vector(spark, rows), "v", layout=layout)
    assert {r.id: r.prefix for r in got.collect()} == running(rows)


@pytest.mark.parametrize("width", [1, 3, 64, 10_000])
def test_dense_cells_of_any_width(spark, width):
    rows = [(i, i % 11) for i in range(-50, 500)]
    got = scan.prefix_sum(vector(spark, rows), "v", layout="dense", width=width)
    assert {r.id: r.prefix for r in got.collect()} == running(rows)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_same_result_for_any_partitioning(spark, partitions, parts):
    partitions(parts)
    rows = [(i * 3, (i * 37) % 101) for i in range(2000)]
    got = scan.prefix_sum(vector(spark, rows, parts), "v")
    assert {r.id: r.prefix for r in got.collect()} == running(rows)


def test_groups_with_null_and_a_hot_one(spark, partitions):
    partitions(8)
    random.seed(1)
    rows = [("hot", i, random.randrange(9)) for i in range(3000)]
    rows += [(random.choice(["a", "b", "", None]), 10_000 + i, random.randrange(9)) for i in range(3000)]
    got = scan.segmented_prefix_sum(grouped(spark, rows), "v", ["g"]).collect()
    assert len(got) == len(rows)
    for name in ("hot", "a", "b", "", None):
        want = running([(i, v) for g, i, v in rows if g == name])
        assert {r.id: r.prefix for r in got if r.g == name} == want


def test_range_layout_splits_a_hot_group(spark, partitions):
    partitions(16)
    rows = [("hot", i, 1) for i in range(8000)] + [(f"g{i}", i, 1) for i in range(4000)]
    cells = scan.lay_out(grouped(spark, rows), ["id"], ["g"])
    sizes = [r["count"] for r in cells.rows.groupBy(*cells.keys).count().collect()]
    assert max(sizes) < 3 * len(rows) / 16
    assert len(sizes) < 4001 + 16


@pytest.mark.parametrize("layout", ["auto", "range"])
def test_exclusive_prefix_and_difference(spark, layout):
    rows = [(i, (i * i) % 17) for i in range(0, 900, 2)]
    before = scan.exclusive_prefix(vector(spark, rows), "v", layout=layout)
    assert {r.id: r.before + r.v for r in before.collect()} == running(rows)
    diff = scan.adjacent_difference(vector(spark, rows), "v", layout=layout)
    values = [0] + [v for _, v in rows]
    assert {r.id: r.diff for r in diff.collect()} == {i: v - p for (i, v), p in zip(rows, values)}


def test_difference_across_cells_of_a_group(spark, partitions):
    partitions(8)
    rows = [("hot", i, i * i) for i in range(500)] + [(None, i, 5) for i in range(50)]
    got = scan.adjacent_difference(grouped(spark, rows), "v", group_cols=["g"]).collect()
    assert {r.id: r["diff"] for r in got if r.g == "hot"} == {0: 0} | {i: 2 * i - 1 for i in range(1, 500)}
    assert {r.id: r["diff"] for r in got if r.g is None} == {0: 5} | {i: 0 for i in range(1, 50)}


def test_difference_keeps_null_values(spark):
    rows = [(1, 5), (2, None), (3, 7)]
    got = scan.adjacent_difference(vector(spark, rows), "v").collect()
    assert {r.id: r["diff"] for r in got} == {1: 5, 2: None, 3: None}


def test_sort_positions_with_ties(spark, partitions):
    partitions(8)
    rows = [(i, 0 if i % 3 else i % 5) for i in range(3000)]
    df = vector(spark, rows).withColumnRenamed("v", "n_copies")
    got = sorting.sort_by_copies(df, with_position=True).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.n_copies, r.position) for r in got] == [(i, c, k + 1) for k, (i, c) in enumerate(want)]
    assert [r.id for r in sorting.sort_by_copies(df).collect()] == [i for i, _ in want]


def test_empty_table(spark):
    assert scan.prefix_sum(vector(spark, [], 1), "v").count() == 0


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**9, 10**12, 10**13])
@pytest.mark.parametrize("parts", [8, 200, 20_000])
def test_bucket_width_bounds_buckets_and_rows(n, parts):
    width = bucket_width(n, parts)
    assert n / width <= MAX_BUCKETS
    assert width <= max(MAX_WIDTH, -(-n // MAX_BUCKETS))


def test_long_sums_fail_rather_than_wrap(spark):
    rows = [(1, 2**62), (2, 2**62), (3, 2**62)]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        scan.prefix_sum(vector(spark, rows), "v").collect()
    wide = vector(spark, rows).withColumn("v", F.col("v").cast("decimal(38,0)"))
    assert scan.prefix_sum(wide, "v").agg(F.max("prefix")).first()[0] == 3 * 2**62


def test_by_group_the_rows_are_shuffled_once_and_not_written(spark, partitions):
    partitions(16)
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 5000)).alias("g"),
        (F.col("id") * F.col("id") % 1_000_003).cast("double").alias("k"),
        F.col("id").alias("v"),
    )
    cells = lay_out(rows, ["k"], ["g"])
    assert "ckpt" not in str(cells.rows.inputFiles())
    counts = cells.rows.groupBy(*cells.keys).count().where("count > 15000").collect()
    assert counts == []  # the hot group of 66,667 rows is cut
    text = prefix_sum(rows, "v", "k", group_cols=["g"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.splitlines() if "Scan ExistingRDD" in line and "v#" in line]
    by_row = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "v#" in line]
    got = prefix_sum(rows, "v", "k", "s", ["g"]).where("g = 'hot'").orderBy("k", "v").toPandas()
    total = got.groupby("k")["v"].sum().cumsum()
    assert got.groupby("k")["s"].max().to_numpy().tolist() == total.to_numpy().tolist()
    assert len(by_row) <= 1


@pytest.mark.parametrize("kind", ["double", "date", "decimal(12,2)", "timestamp", "int"])
@pytest.mark.parametrize("tasks", [1, 40])
def test_quantiles_of_any_ordered_type(spark, partitions, kind, tasks):
    partitions(tasks)
    base = F.col("id") * 7 % 20_011
    key = F.date_add(F.lit("2000-01-01"), base.cast("int")) if kind in ("date", "timestamp") else base
    rows = spark.range(20_011).select(F.lit("a").alias("g"), key.cast(kind).alias("k"), F.lit(1).cast("bigint").alias("one"))
    got = prefix_sum(rows, "one", "k", "place", ["g"], layout="sketched").orderBy("k").toPandas()
    assert got["place"].tolist() == list(range(1, 20_012))


def test_sketched_without_groups_and_null_keys(spark, partitions):
    partitions(8)
    rows = spark.range(30_000).select(
        F.when(F.col("id") > 0, F.col("id") * 10**12).alias("k"), F.lit(2).cast("bigint").alias("v")
    )
    got = prefix_sum(rows, "v", "k", "s").orderBy("k").toPandas()
    assert got["s"].tolist() == list(range(2, 60_001, 2))
