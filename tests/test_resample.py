import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmuration.functions.slots import ONE_32, offset_bits
from murmuration.functions.noise import Noise
from murmuration.operators import resample as rs
from murmuration.operators.vector import range_expand
from murmuration.operators.weights import integer_weights
from murmuration.sources.generate import id_range


def table(spark, weights, first=1, parts=3):
    rows = [(first + k, w, float(k) - 3.0) for k, w in enumerate(weights)]
    return spark.createDataFrame(rows, "id bigint, wq bigint, x double").repartition(parts)


def exact_copies(weights, n, bits):
    """The definition in unbounded integers."""
    if not sum(weights):
        weights = [1] * len(weights)
    total, before, out = sum(weights), 0, []
    for w in weights:
        lo = (before * n * ONE_32 + bits * total) // (total * ONE_32)
        before += w
        hi = (before * n * ONE_32 + bits * total) // (total * ONE_32)
        out.append(hi - lo)
    return out


def copies_of(df):
    return [r.n_copies for r in df.orderBy("id").collect()]


def cases():
    rng = random.Random(5)
    yield "one row", [7], None, 0.5
    yield "equal", [1] * 8, None, 0.0
    yield "equal, late offset", [3] * 999, None, 0.999
    yield "five", [1, 2, 3, 4, 5], None, 0.37
    yield "more slots than rows", [1, 2, 3, 4, 5, 6, 7], 100, 0.37
    yield "fewer slots than rows", [rng.randrange(100) for _ in range(700)], 11, 0.1
    yield "one heavy", [10**10 if k == 40 else 1 for k in range(100)], 5000, 0.2
    yield "zeros mixed", [rng.choice([0, 0, 5, 9]) for _ in range(500)], None, 0.7
    yield "all zero", [0] * 13, None, 0.4
    yield "all zero, other size", [0] * 13, 40, 0.4
    yield "huge weights", [rng.randrange(2**62, 2**63 - 1) for _ in range(300)], None, 0.6
    yield "whole quotients", [2**20 * rng.randrange(4) for _ in range(256)], 1024, 0.0
    yield "random", [rng.randrange(2**40) for _ in range(3000)], None, rng.random()


@pytest.mark.parametrize("name,weights,n,offset", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
@pytest.mark.parametrize("layout", ["auto", "range"])
def test_copies_equal_the_integer_definition(spark, name, weights, n, offset, layout):
    got = copies_of(rs.systematic_copies(table(spark, weights), n=n, offset=offset, layout=layout))
    assert got == exact_copies(weights, n or len(weights), offset_bits(offset))
    assert sum(got) == (n or len(weights))
    total = sum(weights)
    if total:
        assert all(abs(c - (n or len(weights)) * w / total) <= 1 + 1e-9 for c, w in zip(got, weights))


def test_bounded_weights_use_short_sums_with_equal_result(spark):
    rng = random.Random(8)
    weights = [rng.randrange(2**40 + 1) for _ in range(2000)]
    cells = rs.lay_out(table(spark, weights), ["id"], layout="dense", width=100)
    got = copies_of(rs.slots_of(cells, "wq", None, 0.25, "id", weight_bits=40, dense_ids=True))
    assert got == exact_copies(weights, 2000, offset_bits(0.25))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_same_copies_for_any_partitioning(spark, partitions, parts):
    partitions(parts)
    weights = [(k * 7919) % 1000 for k in range(3000)]
    got = copies_of(rs.systematic_copies(table(spark, weights, parts=parts), offset=0.37))
    assert got == exact_copies(weights, 3000, offset_bits(0.37))


def test_groups_resample_apart_and_null_is_a_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(50)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, id bigint, wq bigint")
    got = rs.systematic_copies(df, offset=0.3, group_cols=["g"]).collect()
    for name in ("a", "b", None):
        weights = [w for g, _, w in rows if g == name]
        mine = [r.n_copies for r in sorted((r for r in got if r.g == name), key=lambda r: r.id)]
        assert mine == exact_copies(weights, len(weights), offset_bits(0.3))


def test_floating_weights(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.25), (4, 0.0)], "id bigint, w double")
    assert copies_of(rs.systematic_copies(df, "w")) == [2, 1, 1, 0]


def test_negative_weights_fail(spark):
    with pytest.raises(Exception, match="must not be negative"):
        rs.systematic_copies(table(spark, [1, -1, 2])).collect()


def test_null_weight_counts_as_zero(spark):
    assert copies_of(rs.systematic_copies(table(spark, [1, None, 1]), n=4)) == [2, 0, 2]


def test_too_large_for_38_digits_fails(spark):
    df = table(spark, [2**62] * 8)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="38 digits"):
            rs.systematic_copies(df, n=2**62).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_offset_must_be_a_fraction(spark):
    with pytest.raises(ValueError):
        rs.systematic_copies(table(spark, [1, 2]), offset=1.0)


@pytest.mark.parametrize("width", [1, 7, 64, 2**16])
def test_replication_gives_every_copy_once(spark, width):
    counts = [0, 3, 1, 0, 500, 2, 1, 1, 0, 92]
    df = table(spark, counts).withColumnRenamed("wq", "n_copies")
    got = rs.replicate_by_count(df, width=width).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, sum(counts) + 1))
    assert [r.src for r in got] == [k + 1 for k, c in enumerate(counts) for _ in range(c)]


def test_one_row_with_most_copies_is_shared_out(spark, partitions):
    partitions(8)
    weights = [10**9 if k == 17 else 1 for k in range(1000)]
    out = rs.resample(table(spark, weights), n=200_000, offset=0.5, width=1000)
    rows = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.where("src = 18").count() > 199_000
    assert len(rows) == 8 and max(r["count"] for r in rows) < 3 * 200_000 / 8
    ids = out.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(ids) == (1, 200_000, 200_000)


def test_negative_states_and_minus_one_survive(spark):
    df = table(spark, [5, 5, 5, 5, 5])
    assert sorted(r.x for r in rs.resample(df).collect()) == [-3.0, -2.0, -1.0, 0.0, 1.0]
    doubled = Counter(r.x for r in rs.resample(df, n=10).collect())
    assert doubled == {x: 2 for x in (-3.0, -2.0, -1.0, 0.0, 1.0)}


def test_resample_if_needed_decides_by_group(spark):
    rows = [("even", k, 10) for k in range(20)] + [("odd", k, 10**6 if k == 3 else 1) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, id bigint, wq bigint")
    out = rs.resample_if_needed(df, offset=0.5, group_cols=["g"]).collect()
    even = sorted((r.id, r.src) for r in out if r.g == "even")
    assert even == [(k + 1, k) for k in range(20)]
    assert {r.resampled for r in out if r.g == "even"} == {False}
    assert Counter(r.src for r in out if r.g == "odd") == {3: 20}
    assert {round(r.ess, 3) for r in out if r.g == "even"} == {20.0}


def test_integer_weights_ignore_what_is_not_a_number(spark):
    rows = [(1, -1.0), (2, float("-inf")), (3, None), (4, -1.0)]
    df = spark.createDataFrame(rows, "id bigint, lw double")
    got = {r.id: r.wq for r in integer_weights(df, "lw", log=True, bits=10).collect()}
    assert got == {1: 1024, 2: 0, 3: 0, 4: 1024}


def test_range_expand_over_zero(spark):
    df = spark.createDataFrame([("a", -2, 3), ("b", 7, 7)], "n string, lo bigint, hi bigint")
    got = range_expand(df, F.col("lo"), F.col("hi")).collect()
    assert sorted((r.n, r.id) for r in got) == [("a", k) for k in range(-2, 4)] + [("b", 7)]


def test_overlapping_ranges_are_dealt_evenly(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "src")
    grown = range_expand(rows, F.lit(1), F.lit(3))
    sizes = [r["count"] for r in grown.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) > 1 and max(sizes) < 2 * min(sizes)


def test_huge_ranges_are_cut_in_two_levels(spark):
    row = spark.range(1).select(F.lit(5).cast("bigint").alias("lo"), F.lit(10**12 + 5).cast("bigint").alias("hi"))
    pieces = rs.cut_ranges(row, F.col("lo"), F.col("hi"), 2**16, "piece")
    got = pieces.agg(F.count(F.lit(1)), F.min("piece"), F.max("piece"), F.countDistinct("piece")).first()
    first, last = 5 // 2**16, (10**12 + 4) // 2**16
    assert tuple(got) == (last - first + 1, first, last, last - first + 1)


@pytest.mark.parametrize("name", ["n_copies", "slot_lo", "total_w"])
def test_clashing_columns_are_refused(spark, name):
    df = table(spark, [1, 2, 3])
    with pytest.raises(ValueError, match=name):
        rs.systematic_copies(df.withColumn(name, F.lit(1)))
    with pytest.raises(ValueError, match="src"):
        rs.resample(df.withColumn("src", F.lit(1)))


def test_keyed_rounding_gives_light_weights_their_share(spark):
    """One heavy row and 99,999 light ones, at 12 bits: each light weight is a tenth
    of the unit, so to the nearest all vanish."""
    n, heavy = 100_000, 1.0
    light = 0.1 / 2**12
    rows = id_range(spark, n).withColumn("w", F.when(F.col("id") == 1, F.lit(heavy)).otherwise(F.lit(light)))
    due = n * heavy / (heavy + (n - 1) * light)
    copies = {}
    for name, draw in (("nearest", None), ("keyed", Noise(3).uniform(0, "id"))):
        out = rs.systematic_copies(rows, "w", bits=12, draw=draw)
        copies[name] = out.where("id = 1").first().n_copies
        assert out.agg(F.sum("n_copies")).first()[0] == n
    assert copies["nearest"] == n
    assert copies["keyed"] == pytest.approx(due, rel=0.01)


def test_replicating_reads_its_table_once(spark, folder):
    """Cells, sums and copies come from rows that were written once."""
    rows = spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey as id", "o_orderkey % 3 as n_copies")
    for made in (rs.replicate_by_count(rows), rs.cumulative_slots(rows, "n_copies")):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "parquet" not in text.lower()


def test_cumulative_slots_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "id bigint, wq bigint")
    assert rs.cumulative_slots(rows).collect() == []
    assert rs.replicate_by_count(rows.withColumnRenamed("wq", "n_copies")).collect() == []
