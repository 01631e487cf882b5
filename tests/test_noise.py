import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F

from murmuration import Noise


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_draws_depend_on_the_key_alone(spark, name):
    noise = Noise(11, name)
    drawn = []
    for parts in (1, 4, 32):
        df = spark.range(500).repartition(parts)
        df = df.select("id", noise.uniform(2, "id").alias("u"), noise.gaussian(2, "id").alias("g"))
        drawn.append(sorted(map(tuple, df.collect())))
    assert drawn[0] == drawn[1] == drawn[2]


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_moments(spark, name):
    noise = Noise(5, name)
    rows = spark.range(40_000).select(noise.uniform(1, "id"), noise.gaussian(1, "id"), noise.gaussian(2, "id")).collect()
    u, g, h = zip(*rows)
    assert min(u) >= 0 and max(u) < 1
    assert statistics.fmean(u) == pytest.approx(0.5, abs=0.01)
    assert statistics.fmean(g) == pytest.approx(0.0, abs=0.03)
    assert statistics.pstdev(g) == pytest.approx(1.0, abs=0.03)
    assert abs(statistics.correlation(g, h)) < 0.03
    assert sum(abs(v) > 1.96 for v in g) / len(g) == pytest.approx(0.05, abs=0.01)


def test_md5_draws_by_hand(spark):
    digest = hashlib.md5(b"7:3:2=42").hexdigest()
    u1 = (int(digest[:12], 16) + 1) / (2**48 + 1)
    u2 = int(digest[12:24], 16) / 2**48
    row = spark.range(42, 43).select(Noise(7, "md5").gaussian(3, "id"), Noise(7, "md5").bits32(F.lit(3), "id")).first()
    assert row[0] == pytest.approx(math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2), abs=1e-12)
    assert row[1] == int(digest[:8], 16)


def test_unknown_hash():
    with pytest.raises(ValueError):
        Noise(1, "crc32")


@pytest.mark.parametrize("name", ["xxhash64", "md5"])
def test_keys_do_not_collide(spark, name):
    keys = [(None, "a"), ("a", None), ("a:b", "c"), ("a", "b:c"), ("null", "a"), ("", "a"), (None, None)]
    rows = spark.createDataFrame(keys, "k string, m string")
    draws = [r[0] for r in rows.select(Noise(7, name).uniform(1, "k", "m")).collect()]
    assert len(set(draws)) == len(keys)
