import pytest

from murmuration.plans import stage
from murmuration.sources.generate import id_range
from murmuration.sources.keyvalue import read_keyvalue, write_keyvalue


def test_round_trip(spark):
    rows = [(1, 0.5), (2, -1.25), (3, 1e-9)]
    path = stage.run_folder(spark, "test")
    write_keyvalue(spark.createDataFrame(rows, "id bigint, x double"), path)
    assert sorted(map(tuple, read_keyvalue(spark, path).collect())) == rows
    with pytest.raises(Exception, match="exists"):
        write_keyvalue(spark.createDataFrame(rows, "id bigint, x double"), path)


def test_malformed_line_fails(spark):
    path = stage.run_folder(spark, "test")
    spark.createDataFrame([("1,0.5",), ("two,0.5",)], "line string").write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_keyvalue(spark, path).collect()


def test_id_range(spark):
    assert [r.id for r in id_range(spark, 4).orderBy("id").collect()] == [1, 2, 3, 4]


def test_rebalance_and_shrink(spark):
    df = id_range(spark, 100)
    assert stage.rebalance(df, 5, "id").rdd.getNumPartitions() == 5
    assert stage.shrink(stage.rebalance(df, 5), 2).rdd.getNumPartitions() == 2


def test_materialized_rows_do_not_follow_their_source(spark):
    from pyspark.sql import functions as F

    df = stage.materialize(id_range(spark, 50).withColumn("r", F.rand()))
    assert sorted(df.collect()) == sorted(df.collect())
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_filter_from_text_to_text(spark):
    from murmuration.__main__ import main

    folder = stage.run_folder(spark, "test")
    start = spark.createDataFrame([(k, 0.5 + k / 200) for k in range(1, 65)], "id bigint, x double")
    write_keyvalue(start, f"{folder}/particles")
    seen = spark.createDataFrame([(1, 3.0), (2, 9.0)], "step int, z double")
    write_keyvalue(seen, f"{folder}/observations", "step", "z")
    main([f"{folder}/particles", f"{folder}/observations", f"{folder}/out", "--seed", "3"])
    assert read_keyvalue(spark, f"{folder}/out/particles").count() == 64
    report = spark.read.option("header", True).csv(f"{folder}/out/report")
    assert report.columns == ["step", "z", "ess", "resampled", "estimate"] and report.count() == 2
