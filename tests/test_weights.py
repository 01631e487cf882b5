import math
import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import aggregates, joins, weights
from murmuration.operators.attach import attach
from murmuration.operators.resample import systematic_copies


def logs(spark, rows):
    return spark.createDataFrame(rows, "g string, id bigint, lw double").repartition(3)


def sample(seed=3, groups=("a", "b", None)):
    rng = random.Random(seed)
    return [(rng.choice(groups), k, rng.gauss(-3, 2)) for k in range(400)]


def test_weights_sum_to_one(spark):
    normal = weights.normalize_weights(logs(spark, sample()))
    assert normal.agg(F.sum(F.exp("lw"))).first()[0] == pytest.approx(1.0)


def test_weights_sum_to_one_in_each_group(spark):
    rows = sample()
    normal = weights.normalize_weights(logs(spark, rows), group_cols=["g"])
    sums = {r.g: r.s for r in normal.groupBy("g").agg(F.sum(F.exp("lw")).alias("s")).collect()}
    assert set(sums) == {"a", "b", None} and all(s == pytest.approx(1.0) for s in sums.values())
    assert normal.count() == len(rows)


def test_very_negative_log_weights_stay_finite(spark):
    rows = [(None, k, -1e5 - k) for k in range(50)]
    total = weights.log_sum_exp(logs(spark, rows)).first()[0]
    assert total == pytest.approx(-1e5 + math.log(sum(math.exp(-k) for k in range(50))))
    normal = weights.normalize_weights(logs(spark, rows))
    assert normal.agg(F.sum(F.exp("lw"))).first()[0] == pytest.approx(1.0)


def test_effective_sample_size_bounds(spark):
    equal = weights.normalize_weights(logs(spark, [(None, k, 0.5) for k in range(64)]))
    assert weights.effective_sample_size(equal).first()[0] == pytest.approx(64.0)
    one = weights.normalize_weights(logs(spark, [(None, k, 0.0 if k == 9 else -2000.0) for k in range(64)]))
    assert weights.effective_sample_size(one).first()[0] == pytest.approx(1.0)
    mixed = weights.normalize_weights(logs(spark, sample()), group_cols=["g"])
    for row in weights.effective_sample_size(mixed, group_cols=["g"]).collect():
        assert 1.0 <= row.ess <= 400.0


def test_means(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 0.0, 9.0)], "id bigint, w double, x double")
    assert aggregates.weighted_mean(df).first()[0] == pytest.approx(14.0 / 4.0)
    assert aggregates.posterior_mean(df).first()[0] == pytest.approx(5.0)
    assert aggregates.weighted_mean(df.withColumn("w", F.lit(0.0))).first()[0] is None


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows", [1000, 3])
def test_attach_gives_the_same_rows_either_way(spark, how, broadcast_rows):
    rng = random.Random(4)
    rows = [("hot", k) for k in range(500)] + [(rng.choice(["a", "b", "c", "d", "e", None]), 500 + k) for k in range(500)]
    left = spark.createDataFrame(rows, "g string, id bigint")
    facts = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), (None, 4), ("zz", 5)], "g string, f int")
    got = attach(left, facts, ["g"], how, broadcast_rows=broadcast_rows).collect()
    known = {"hot": 1, "a": 2, "b": 3, None: 4}
    want = [(g, i, known.get(g)) for g, i in rows if how == "left" or g in known]
    assert sorted((r.id, str(r.g), r.f) for r in got) == sorted((i, str(g), f) for g, i, f in want)


def test_attach_beyond_the_limit_broadcasts_heavy_keys_only(spark):
    rows = [("hot", k) for k in range(3000)] + [(f"g{k}", k) for k in range(3000)]
    left = spark.createDataFrame(rows, "g string, id bigint")
    facts = left.groupBy("g").agg(F.count("*").alias("f"))
    got = attach(left, facts, ["g"], broadcast_rows=100)
    assert got.count() == 6000
    assert {r.f for r in got.where("g = 'hot'").collect()} == {3000}


def test_merge_by_max_keeps_negative_and_unmatched(spark):
    a = spark.createDataFrame([(1, -5.0), (2, -1.0), (3, 4.0)], "id bigint, x double")
    b = spark.createDataFrame([(2, -3.0), (3, 9.0), (4, -1.0), (4, -0.5)], "id bigint, x double")
    got = {r.id: r.x for r in joins.merge_by_max(a, b, ["x"]).collect()}
    assert got == {1: -5.0, 2: -1.0, 3: 9.0, 4: -0.5}


def test_gather_by_rotation(spark):
    df = spark.createDataFrame([(k, k * 10) for k in range(1, 9)], "id bigint, v bigint")
    got = joins.gather_by_index(df, "v", joins.rotated_index("id", 3, 8)).collect()
    assert {r.id: r.gathered for r in got} == {k: ((3 + k - 1) % 8 + 1) * 10 for k in range(1, 9)}


def test_what_is_not_a_number_has_no_weight(spark):
    rows = [(1, 1.0), (2, 9.0), (3, float("nan")), (4, 90.0), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, w double")
    copies = {r.id: r.n_copies for r in systematic_copies(df, "w", 100).collect()}
    assert sum(copies.values()) == 100 and copies[3] == copies[5] == 0
    assert all(abs(copies[k] - due) <= 1 for k, due in ((1, 1), (2, 9), (4, 90)))
    with pytest.raises(Exception, match="infinite"):
        systematic_copies(df.union(spark.createDataFrame([(6, float("inf"))], df.schema)), "w", 100).collect()


def test_without_any_weight_all_are_equal(spark):
    nothing = float("-inf")
    df = spark.createDataFrame([(1, nothing), (2, float("nan")), (3, None), (4, nothing)], "id bigint, lw double")
    assert weights.log_sum_exp(df).first()[0] == nothing
    assert [r.lw for r in weights.normalize_weights(df).collect()] == pytest.approx([-math.log(4)] * 4)


def test_totals_of_weights_far_apart(spark):
    values = [-1e5, -1e5 + 1.5, -300.0, 700.0, 700.5, 690.0, float("-inf"), float("nan"), None, -1e300, 0.0]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, lw double")
    for spread in (rows.coalesce(1), rows.repartition(7)):
        for row in weights.weight_totals(spread, group_cols=["g"]).collect():
            own = [v for i, v in enumerate(values) if i % 2 == row.g and v is not None and v == v and v > float("-inf")]
            peak = max(own)
            parts = [math.exp(v - peak) for v in own]
            assert row.log_total == pytest.approx(peak + math.log(sum(parts)), rel=1e-14)
            assert row.ess == pytest.approx(sum(parts) ** 2 / sum(p * p for p in parts), rel=1e-12)
            assert row.rows == sum(i % 2 == row.g for i in range(len(values)))


def test_totals_where_no_row_has_weight(spark):
    nothing = float("-inf")
    rows = spark.createDataFrame([("a", nothing), ("a", None), (None, 1.0)], "g string, lw double")
    got = {r.g: (r.log_total, round(r.ess, 9), r.rows) for r in weights.weight_totals(rows, group_cols=["g"]).collect()}
    assert got == {"a": (nothing, 2.0, 2), None: (1.0, 1.0, 1)}
    empty = weights.weight_totals(rows.where("g = 'x'")).first()
    assert (empty.log_total, empty.rows) == (None, None)


def test_normalizing_scans_twice(spark, folder):
    rows = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id as id", "value as lw", "user_id")
    text = weights.normalize_weights(rows)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2
