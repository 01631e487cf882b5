import math
import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import aggregates
from murmuration.operators.exact import exact_sums

INF = float("inf")


def sums(df, groups=()):
    return {tuple(r[:-1]): r[-1] for r in exact_sums(df, {"total": F.col("x")}, list(groups)).collect()}


def test_equal_to_the_last_bit_for_any_partitioning(spark):
    draw = random.Random(5)
    rows = [(k, k % 3, draw.gauss(0, 1) * 2.0 ** draw.randint(-60, 60)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g int, x double")
    seen = []
    for n in (1, 4, 32):
        mixed = df.repartition(n, F.xxhash64("id", F.lit(n)))
        seen.append((sums(mixed, ["g"]), aggregates.posterior_mean(mixed, reproducible=True).first()[0]))
    assert seen[0] == seen[1] == seen[2]
    for (g,), total in seen[0][0].items():
        assert total == pytest.approx(math.fsum(x for _, h, x in rows if h == g), rel=1e-14)


def test_every_power_of_two_comes_back(spark):
    """One value to a group: each bin and each edge of a bin, subnormal ones too."""
    values = [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1072, 1024, 3)]
    values += [-v for v in values[::7]] + [1.7976931348623157e308, 0.1, 1 / 3]
    df = spark.createDataFrame(list(enumerate(values)), "g int, x double")
    assert sums(df, ["g"]) == {(k,): v for k, v in enumerate(values)}


def test_what_cancels_out_leaves_the_rest(spark):
    rows = [(1e300,), (1.0,), (-1e300,), (2.0**-70,), (-1.0,)]
    assert sums(spark.createDataFrame(rows, "x double")) == {(): 2.0**-70}


def test_odd_values(spark):
    rows = [
        ("null", None), ("mixed", None), ("mixed", 2.0), ("zero", 0.0), ("zero", -0.0),
        ("inf", INF), ("inf", 1.0), ("both", INF), ("both", -INF), ("nan", float("nan")), ("nan", 1.0), (None, 4.0),
    ]
    got = sums(spark.createDataFrame(rows, "g string, x double"), ["g"])
    assert got[("null",)] is None and got[("mixed",)] == 2.0 and got[("zero",)] == 0.0 and got[("inf",)] == INF
    assert math.isnan(got[("both",)]) and math.isnan(got[("nan",)]) and got[(None,)] == 4.0
    empty = spark.createDataFrame([], "g string, x double")
    assert sums(empty) == {(): None} and sums(empty, ["g"]) == {}


def test_means(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 6.0, 1.0), (2, 5.0, 0.0), (2, None, 0.0)], "g int, x double, w double")
    weighted = aggregates.weighted_mean(df, group_cols=["g"], reproducible=True).collect()
    assert {r.g: r.estimate for r in weighted} == {1: 3.0, 2: None}
    plain = aggregates.posterior_mean(df, group_cols=["g"], reproducible=True).collect()
    assert {r.g: r.estimate for r in plain} == {1: 4.0, 2: 5.0}
