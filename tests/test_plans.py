"""What the plans look like, so that they hold at any size."""

import re

import pytest
from pyspark.sql import Window, functions as F

from murmuration import Noise
from murmuration.catalog.queries import QUERIES
from murmuration.operators import joins, resample as rs
from murmuration.operators.scan import BUCKET, lay_out
from murmuration.plans import grouped
from murmuration.plans.filter import bucket_of
from murmuration.plans.stage import _planner, _seen_from, keep, materialize_partitioned
from murmuration.sources.generate import id_range

LOOPS = {name for name in QUERIES if name.startswith(("run_filter", "step_report", "filter_step"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (hash|range|round|Single)", text))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LOOPS))
def test_no_cross_join_no_python_no_single_task_window(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert word not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # Only aggregates may meet in one task: partial ones, or one row per cell.
            assert "HashAggregate" in lines[i + 1], text


@pytest.mark.parametrize("name", ["prefix_sum", "systematic_copies", "resample"])
def test_scans_read_two_columns(spark, folder, name):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(QUERIES[name](spark, folder)))
    assert schemas and set(schemas) <= {"event_id:bigint,value:double"}


def population(spark, n, width):
    df = id_range(spark, n).withColumn("x", F.lit(1.0)).withColumn("wq", F.pmod("id", F.lit(97)))
    return df.withColumn(BUCKET, bucket_of("id", width))


def step_plan(rows, width):
    cells = lay_out(rows, ["id"], layout="carried", width=width)
    slots = rs.slots_of(cells, "wq", None, 0.5, "id", weight_bits=40, dense_ids=True)
    slots = slots.select("id", "x", "slot_lo", "slot_hi")
    return rs.replicate_balanced(slots, width=width, bucket=BUCKET).select("id", "x", BUCKET)


@pytest.mark.parametrize("n", [2**6, 2**10, 2**16, 2**20])
def test_shuffles_per_step_do_not_depend_on_n(spark, n):
    assert exchanges(plan(step_plan(population(spark, n, 4096), 4096))) <= 6


def test_without_broadcast_the_rows_are_shuffled_twice(spark):
    """Once to scan, once to spread the copies; the rest is one row per cell."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(step_plan(population(spark, 2**16, 4096), 4096))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    assert exchanges(text) == 5
    assert text.count("hashpartitioning(_bucket") == 4


def test_next_step_starts_from_the_partitioning_of_the_last(spark):
    after, _ = materialize_partitioned(step_plan(population(spark, 10_000, 512), 512))
    inside = Window.partitionBy(BUCKET).orderBy("id")
    text = plan(after.withColumn("s", F.sum("x").over(inside)))
    assert exchanges(text) == 0, text
    weighted = after.withColumn("wq", F.pmod("id", F.lit(97)))
    before = exchanges(plan(step_plan(population(spark, 10_000, 512), 512)))
    assert exchanges(plan(step_plan(weighted, 512))) < before


def test_grouped_step_starts_from_the_partitioning_of_the_last(spark):
    rows = population(spark, 10_000, 512).withColumn("g", F.pmod("id", F.lit(7)))
    cells = lay_out(rows.withColumn("g", F.coalesce("g", F.lit(0))), ["id"], ["g"], layout="carried", width=512)
    slots = rs.slots_of(cells, "wq", None, 0.5, "id", 0.5, weight_bits=40)
    slots = slots.select("g", "id", "x", "slot_lo", "slot_hi")
    grown = rs.replicate_balanced(slots, group_cols=["g"], width=512, bucket=BUCKET)
    after, _ = materialize_partitioned(grown.select("g", "id", "x", BUCKET))
    inside = Window.partitionBy("g", BUCKET).orderBy("id")
    assert exchanges(plan(after.withColumn("s", F.sum("x").over(inside)))) == 0


def test_noise_stays_in_codegen(spark):
    text = spark.range(10).select(Noise(1).gaussian(1, "id"))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in text


def test_a_gathered_index_that_all_rows_name_is_spread(spark, partitions):
    """Beyond a broadcast, the named value is joined to the rows where they are."""
    partitions(8)
    rows = id_range(spark, 40_000).withColumn("x", F.col("id").cast("double")).repartition(8)
    out = joins.gather_by_index(rows, "x", F.lit(7), broadcast_rows=100)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 6_000
    assert {r.gathered for r in out.select("gathered").distinct().collect()} == {7.0}


def test_the_callers_session_keeps_adaptive_execution(spark, monkeypatch):
    """Nothing sets the switch in it, and the written frame belongs to it."""
    seen = []
    conf = type(spark.conf)
    plain = conf.set

    def watched(self, key, value):
        seen.append((self is spark.conf, key))
        plain(self, key, value)

    monkeypatch.setattr(conf, "set", watched)
    after, row = materialize_partitioned(step_plan(population(spark, 1_000, 512), 512), F.max("id").alias("most"))
    assert not [key for own, key in seen if own and key.startswith("spark.sql.adaptive")]
    assert after.sparkSession is spark and after.count() == row[0]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_the_cached_rows_are_written_not_made_again(spark):
    """The session that plans the frame reads the cache of the caller's."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = population(spark, 1_000, 512).repartition(4, BUCKET).mapInArrow(count, "id bigint, x double, wq bigint, _bucket bigint")
    after, _ = materialize_partitioned(rows)
    assert after.count() == 1_000 and made.value == 1_000
    kept = keep(population(spark, 1_000, 512).repartition(4, BUCKET))
    kept.count()
    with _seen_from(_planner(spark), kept.withColumn("y", F.col("x") + 1)) as planned:
        assert "InMemoryTableScan" in planned._jdf.queryExecution().executedPlan().toString()
    assert kept.storageLevel.useMemory and "InMemoryTableScan" in plan(kept)
    kept.unpersist()


def test_facts_of_cells_are_read_by_few_tasks(spark):
    assert grouped._few(spark.range(0, 1000, 1, 50)).rdd.getNumPartitions() == 1


def test_means_of_a_grouped_step_come_from_the_pass_that_writes(spark):
    rows = spark.range(1000).selectExpr("id % 7 as _g0", "false as _n0", "0L as _bucket", "double(id) as x")
    keys = ["_g0", "_n0"]
    _, means = materialize_partitioned(
        rows.repartition(4, *keys, "_bucket"), facts=lambda kept: grouped._few(grouped._means(kept, keys))
    )
    assert means.rdd.getNumPartitions() == 1
    assert sorted((r._n, r._sum) for r in means.collect()) == sorted(
        (len(range(k, 1000, 7)), float(sum(range(k, 1000, 7)))) for k in range(7)
    )
