"""One query per operator: ``(spark, folder of parquet tables) -> DataFrame``.

Each reads its whole tables. Doubles are rounded to six places, because two
engines may differ in the last bit of ``exp`` or in the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.functions import model as models
from murmuration.functions.noise import Noise
from murmuration.operators import aggregates, joins, resample, scan, sorting, vector, weights
from murmuration.operators.attach import attach
from murmuration.plans import stage
from murmuration.plans.filter import FilterRun, FilterSettings, filter_step, run_filter
from murmuration.plans.grouped import run_filter_grouped
from murmuration.sources.generate import id_range
from murmuration.sources.keyvalue import read_keyvalue, write_keyvalue
from murmuration.sources.merge import merge_sources

# Parameters shared with the checking SQL.
SEED = 20
NODE = 64
SHIFT = 7
LIMIT = 3000
OFFSET = 0.37
TARGET = 50.0
SPREAD = 400.0
LOOP_VARIANCE = 25.0
COARSE = 12

NOISE = Noise(SEED, "md5")
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """(id, x): event ids from 0 and their values."""
    return _table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("value").alias("x"), *extra
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """(id, v): order keys and totals."""
    return _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")
    )


def particles(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """(id, x): ids from 1."""
    return events(spark, folder, *extra).withColumn("id", F.col("id") + F.lit(1))


def cents(df: DataFrame) -> DataFrame:
    """(.., wq): the value in whole cents, an integer weight."""
    return df.withColumn("wq", F.floor(F.col("x") * 100 + F.lit(0.5))).drop("x")


def log_weights(df: DataFrame) -> DataFrame:
    """(.., lw): how well the value fits a normal around the target."""
    fit = models.gaussian_log_weight(F.lit(TARGET), F.col("x"), SPREAD)
    return df.withColumn("lw", fit)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to six places; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# --- sources and sinks -------------------------------------------------------


def scan_keyvalue_text(spark, folder):
    path = stage.run_folder(spark, "keyvalue")
    write_keyvalue(events(spark, folder), path)
    return read_keyvalue(spark, path)


def sink_keyvalue_text(spark, folder):
    path = stage.run_folder(spark, "keyvalue")
    write_keyvalue(events(spark, folder), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def merge_sources_query(spark, folder):
    path = stage.run_folder(spark, "keyvalue")
    write_keyvalue(events(spark, folder), path)
    return merge_sources(
        {
            "events": (read_keyvalue(spark, path), {"id": F.col("id"), "v": F.col("x")}),
            "orders": (
                _table(spark, folder, "orders"),
                {"id": F.col("o_orderkey"), "v": F.col("o_totalprice")},
            ),
        }
    )


def id_range_source(spark, folder):
    return id_range(spark, _table(spark, folder, "lineitem").count())


def materialize_step(spark, folder):
    moved = vector.propagate_state(particles(spark, folder), models.growth_model(), NOISE, 1)
    return rounded(stage.materialize(moved), "x")


def rebalance(spark, folder):
    both = joins.union_all(events(spark, folder), orders(spark, folder).withColumnRenamed("v", "x"))
    return stage.rebalance(both, None, "id")


# --- projections, scalar expressions, filters --------------------------------


def init_particles(spark, folder):
    return rounded(vector.init_particles(particles(spark, folder), NOISE), "x")


def propagate_state(spark, folder):
    return rounded(vector.propagate_state(particles(spark, folder), models.growth_model(), NOISE, 2), "x")


def measurement(spark, folder):
    return rounded(events(spark, folder).select("id", models.measurement(F.col("x")).alias("h")), "h")


def log_weight(spark, folder):
    return rounded(log_weights(events(spark, folder)).select("id", "lw"), "lw")


def linear_weight(spark, folder):
    weighed = log_weights(events(spark, folder))
    return rounded(weighed.select("id", models.linear_weight(F.col("lw")).alias("w")), "w")


def quantize_offset_query(spark, folder):
    return resample.cumulative_slots(cents(events(spark, folder)), offset=OFFSET)


def node_bucket(spark, folder):
    return vector.node_bucket(particles(spark, folder), NODE).select("id", "node")


def clamp_counts(spark, folder):
    return vector.clamp_counts(cents(events(spark, folder)), "wq", F.lit(LIMIT)).select("id", "low", "high")


def keyed_noise(spark, folder):
    draws = particles(spark, folder).select(
        "id", NOISE.uniform(3, "id").alias("u"), NOISE.gaussian(3, "id").alias("g")
    )
    return rounded(draws, "u", "g")


def keyed_noise_by_group(spark, folder):
    """Keys of text, one of which is sometimes missing."""
    user = F.when(F.col("id") % 7 != 0, F.col("user_id").cast("string")).alias("k")
    rows = particles(spark, folder, "user_id", "event_type").select("id", "event_type", user)
    keys = "event_type", "k", "id"
    draws = rows.select("id", NOISE.uniform(3, *keys).alias("u"), NOISE.gaussian(3, *keys).alias("g"))
    return rounded(draws, "u", "g")


def half_filter(spark, folder):
    rows = particles(spark, folder)
    lower = vector.half_filter(rows, NODE, lower=True).withColumn("half", F.lit("lower"))
    upper = vector.half_filter(rows, NODE, lower=False).withColumn("half", F.lit("upper"))
    return joins.union_all(lower, upper)


def threshold_flag(spark, folder):
    return vector.threshold_flag(cents(events(spark, folder)), F.col("wq") > F.lit(LIMIT)).select("id", "flag")


def negate_flag(spark, folder):
    flagged = vector.threshold_flag(cents(events(spark, folder)), F.col("wq") > F.lit(LIMIT))
    return vector.negate_flag(flagged).select("id", "flag", "negated")


def rekey(spark, folder):
    rows = vector.node_bucket(particles(spark, folder), NODE)
    return vector.rekey(rows, F.col("id") + F.col("node")).select("id", "x")


def drop_sentinel(spark, folder):
    aligned = orders(spark, folder).join(events(spark, folder), "id", "left")
    return vector.drop_missing(aligned, "x").select("id", "x", "v")


def tag_and_pair(spark, folder):
    rows = vector.node_bucket(particles(spark, folder), NODE)
    paired = vector.tag_and_pair(rows, F.col("node"), {"member": "id", "state": "x"})
    return paired.select("key", F.col("pair.member").alias("member"), F.col("pair.state").alias("state"))


def range_expand(spark, folder):
    rows = vector.node_bucket(cents(particles(spark, folder)), NODE)
    nodes = aggregates.tree_sum(rows, "wq", ["node"])
    last = F.col("node") * F.lit(NODE)
    return vector.range_expand(nodes, last - F.lit(NODE - 1), last).select("id", "node", "total")


# --- joins -------------------------------------------------------------------


def join_on_id(spark, folder):
    return joins.join_on_id(events(spark, folder), orders(spark, folder))


def join_scalar(spark, folder):
    return joins.join_scalar(events(spark, folder), F.max("x"), "max_x")


def join_node_value(spark, folder):
    rows = cents(events(spark, folder, "user_id"))
    return joins.join_node_value(rows, aggregates.tree_sum(rows, "wq", ["user_id"]), ["user_id"])


def merge_by_max(spark, folder):
    rows = events(spark, folder)
    shifted = vector.rekey(rows, F.col("id") + F.lit(LIMIT))
    return joins.merge_by_max(rows, shifted, ["x"])


def gather_by_index(spark, folder):
    rows = vector.node_bucket(particles(spark, folder), NODE)
    index = joins.rotated_index("id", SHIFT, NODE, 1) + (F.col("node") - F.lit(1)) * F.lit(NODE)
    return joins.gather_by_index(rows, "x", index).select("id", "gathered")


def elementwise_combine(spark, folder):
    combined = joins.elementwise_combine(events(spark, folder), orders(spark, folder), "x", "v")
    return rounded(combined, "product", "total", "abs_diff")


# --- aggregations ------------------------------------------------------------


def max_weight(spark, folder):
    return rounded(aggregates.max_weight(log_weights(events(spark, folder))), "max_w")


def tree_sum(spark, folder):
    return aggregates.tree_sum(cents(events(spark, folder)), "wq")


def tree_sum_by_node(spark, folder):
    return aggregates.tree_sum(cents(events(spark, folder, "user_id")), "wq", ["user_id"])


def range_expand_overlapping(spark, folder):
    """Every row to the same few keys: one value for all, or parent to children."""
    rows = events(spark, folder).select(F.col("id").alias("src"))
    return vector.range_expand(rows, F.lit(1), F.col("src") % 3 + F.lit(1)).select("src", "id")


def log_sum_exp(spark, folder):
    return rounded(weights.log_sum_exp(log_weights(events(spark, folder))), "log_total")


def weight_totals(spark, folder):
    """Total, effective sample size and rows of every user, from one scan."""
    totals = weights.weight_totals(log_weights(events(spark, folder, "user_id")), group_cols=["user_id"])
    return rounded(totals, "log_total", "ess")


def log_sum_exp_by_group(spark, folder):
    rows = log_weights(events(spark, folder, "user_id"))
    return rounded(weights.log_sum_exp(rows, group_cols=["user_id"]), "log_total")


def normalize_weights(spark, folder):
    normal = weights.normalize_weights(log_weights(events(spark, folder)))
    return rounded(normal.select("id", "lw"), "lw")


def normalize_weights_by_group(spark, folder):
    rows = log_weights(events(spark, folder, "user_id"))
    normal = weights.normalize_weights(rows, group_cols=["user_id"])
    return rounded(normal.select("id", "user_id", "lw"), "lw")


def normalize_weights_degenerate(spark, folder):
    """Groups in which all, some or none have a weight, and some are not numbers."""
    nothing, kind = F.lit(float("-inf")), F.col("user_id") % 3
    rows = log_weights(events(spark, folder, "user_id"))
    lost = (kind == 0) | ((kind == 1) & (F.col("id") % 2 == 0))
    spoilt = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(lost, nothing).otherwise(F.col("lw"))
    normal = weights.normalize_weights(rows.withColumn("lw", spoilt), group_cols=["user_id"])
    return rounded(normal.select("id", "user_id", F.exp("lw").alias("w")), "w")


def effective_sample_size(spark, folder):
    normal = weights.normalize_weights(log_weights(events(spark, folder)))
    return rounded(weights.effective_sample_size(normal), "ess")


def effective_sample_size_by_group(spark, folder):
    rows = log_weights(events(spark, folder, "user_id"))
    normal = weights.normalize_weights(rows, group_cols=["user_id"])
    return rounded(weights.effective_sample_size(normal, group_cols=["user_id"]), "ess")


def weighted_mean(spark, folder):
    rows = weights.normalize_weights(log_weights(events(spark, folder, "user_id")), group_cols=["user_id"])
    rows = rows.withColumn("w", F.exp("lw"))
    return rounded(aggregates.weighted_mean(rows, group_cols=["user_id"]), "estimate")


def posterior_mean(spark, folder):
    return rounded(aggregates.posterior_mean(events(spark, folder)), "estimate")


def tree_sum_reproducible(spark, folder):
    """Sums of doubles, of which a tenth is scaled down by 2^60 and lies in other bins."""
    rows = events(spark, folder, "user_id")
    rows = rows.withColumn("x", F.when(F.col("id") % 10 == 0, F.col("x") * F.lit(2.0**-60)).otherwise(F.col("x")))
    return rounded(aggregates.tree_sum(rows, "x", ["user_id"], reproducible=True), "total")


def weighted_mean_reproducible(spark, folder):
    rows = weights.normalize_weights(log_weights(events(spark, folder, "user_id")), group_cols=["user_id"])
    rows = rows.withColumn("w", F.exp("lw"))
    return rounded(aggregates.weighted_mean(rows, group_cols=["user_id"], reproducible=True), "estimate")


def posterior_mean_reproducible(spark, folder):
    return rounded(aggregates.posterior_mean(events(spark, folder), reproducible=True), "estimate")


def group_max_key(spark, folder):
    rows = vector.node_bucket(particles(spark, folder), NODE)
    return aggregates.group_max_key(rows, "node", size=NODE)


def count_rows(spark, folder):
    return aggregates.count_rows(_table(spark, folder, "lineitem"))


def conditional_count(spark, folder):
    rows = cents(events(spark, folder, "user_id"))
    wq = F.col("wq")
    conditions = {"n_left": wq <= F.lit(LIMIT), "n_right": wq > F.lit(LIMIT)}
    return aggregates.conditional_count(rows, conditions, ["user_id"])


# --- window-type operators, sort, union --------------------------------------


def prefix_sum(spark, folder):
    return scan.prefix_sum(cents(events(spark, folder)), "wq")


def segmented_prefix_sum(spark, folder):
    return scan.segmented_prefix_sum(cents(events(spark, folder, "user_id")), "wq", ["user_id"])


def exclusive_prefix(spark, folder):
    return scan.exclusive_prefix(cents(events(spark, folder)), "wq")


def adjacent_difference(spark, folder):
    return scan.adjacent_difference(cents(events(spark, folder)), "wq")


def adjacent_difference_by_group(spark, folder):
    rows = cents(events(spark, folder, "user_id"))
    return scan.adjacent_difference(rows, "wq", group_cols=["user_id"])


def _copies(spark, folder):
    return resample.systematic_copies(cents(events(spark, folder)), offset=OFFSET)


def sort_by_copies(spark, folder):
    copies = _copies(spark, folder).select("id", "n_copies")
    return sorting.sort_by_copies(copies, with_position=True)


def union_all(spark, folder):
    return joins.union_all(events(spark, folder), orders(spark, folder).withColumnRenamed("v", "x"))


# --- resampling and filter ---------------------------------------------------


def systematic_copies(spark, folder):
    return _copies(spark, folder).select("id", "slot_lo", "slot_hi", "n_copies")


def systematic_copies_by_group(spark, folder):
    rows = cents(events(spark, folder, "user_id"))
    offset = NOISE.bits32(1, "user_id")
    copies = resample.systematic_copies(rows, offset=offset, group_cols=["user_id"])
    return copies.select("user_id", "id", "slot_lo", "slot_hi", "n_copies")


def systematic_copies_rounded(spark, folder):
    """Weights of a few bits, rounded by a draw for each row."""
    weighed = weights.integer_weights(
        log_weights(events(spark, folder)), "lw", log=True, bits=COARSE, draw=NOISE.uniform(4, "id")
    )
    return resample.systematic_copies(weighed.select("id", "wq"), offset=OFFSET).select("id", "wq", "n_copies")


def systematic_copies_lineitem(spark, folder):
    """Order keys drawn in proportion to the price of their lines."""
    lines = _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).alias("wq")
    )
    per_order = aggregates.tree_sum(lines, "wq", ["id"], "wq")
    return resample.systematic_copies(per_order, offset=OFFSET).select("id", "wq", "n_copies")


def replicate_by_count(spark, folder):
    copies = _copies(spark, folder).select("id", "n_copies")
    return resample.replicate_by_count(copies).select("src", "id")


def replicate_balanced(spark, folder):
    """Cubed weights: few rows take most of the copies."""
    rows = cents(events(spark, folder)).withColumn("wq", F.col("wq") * F.col("wq") * F.col("wq"))
    copies = resample.systematic_copies(rows, offset=OFFSET)
    return resample.replicate_balanced(copies.select("id", "slot_lo", "slot_hi"), width=256).select("src", "id")


def resample_query(spark, folder):
    rows = events(spark, folder)
    rows = rows.withColumn("wq", F.floor(F.col("x") * 100 + F.lit(0.5)))
    return resample.resample(rows, offset=OFFSET).select("src", "id", "x")


def resample_if_needed(spark, folder):
    """Per user: some have even enough weights to stay as they are."""
    rows = log_weights(events(spark, folder, "user_id"))
    weighed = weights.integer_weights(rows, "lw", ["user_id"], log=True).drop("lw")
    offset = NOISE.bits32(1, "user_id")
    out = resample.resample_if_needed(weighed, fraction=0.65, offset=offset, group_cols=["user_id"])
    return rounded(out.select("user_id", "src", "id", "x", "ess", "resampled"), "ess")


def _observations(spark, folder, *groups: str) -> DataFrame:
    """One observation per event type (and group): its total cents, wrapped
    into the range of the sensor. Steps follow the type names."""
    rows = _table(spark, folder, "events")
    kinds = rows.groupBy("event_type").count().select("event_type")
    steps = scan.row_positions(kinds, ["event_type"], "step")
    per_type = rows.groupBy(*groups, "event_type").agg(
        F.sum(F.floor(F.col("value") * 100 + F.lit(0.5))).alias("total")
    )
    numbered = attach(per_type, steps, ["event_type"])
    return numbered.select(*groups, F.col("step").cast("int").alias("step"), (F.pmod("total", F.lit(2000)) / 100).alias("z"))


def _settings(**more) -> FilterSettings:
    return FilterSettings(models.growth_model(measurement_variance=LOOP_VARIANCE), NOISE, **more)


def _run(spark, folder, **more) -> FilterRun:
    return run_filter(
        events(spark, folder), _observations(spark, folder), _settings(**more), models.INITIAL_VARIANCE
    )


def _run_by_user(spark, folder, **more) -> FilterRun:
    return run_filter_grouped(
        events(spark, folder, "user_id"),
        _observations(spark, folder, "user_id"),
        ["user_id"],
        _settings(**more),
        models.INITIAL_VARIANCE,
    )


def _resumed(spark, folder, *groups: str) -> FilterRun:
    """A run that ends after two steps, and another that goes on from its folder."""
    start, seen = events(spark, folder, *groups), stage.materialize(_observations(spark, folder, *groups))
    rest = {"settings": _settings(), "initial_variance": models.INITIAL_VARIANCE, "store": stage.run_folder(spark, "run")}
    run = partial(run_filter_grouped, group_cols=list(groups)) if groups else run_filter
    run(start, seen.where("step <= 2"), **rest)
    return run(start, seen, **rest)


def filter_step_query(spark, folder):
    run = filter_step(particles(spark, folder), 1, 12.5, _settings())
    return rounded(run.particles, "x")


def run_filter_query(spark, folder):
    return rounded(_run(spark, folder).particles, "x")


def step_report(spark, folder):
    return rounded(_run(spark, folder).report, "z", "ess", "estimate")


def run_filter_grouped_query(spark, folder):
    return rounded(_run_by_user(spark, folder).particles, "x")


def step_report_grouped(spark, folder):
    return rounded(_run_by_user(spark, folder).report, "z", "ess", "estimate")


def step_report_weighted(spark, folder):
    return rounded(_run(spark, folder, estimate="weighted").report, "z", "ess", "estimate")


def step_report_carried(spark, folder):
    run = _run(spark, folder, estimate="weighted", carry_weights=True)
    return rounded(run.report, "z", "ess", "estimate")


def step_report_carried_grouped(spark, folder):
    run = _run_by_user(spark, folder, estimate="weighted", carry_weights=True)
    return rounded(run.report, "z", "ess", "estimate")


def step_report_offset(spark, folder):
    """A given offset for every resampling, and weights rounded by a draw."""
    return rounded(_run(spark, folder, offset=OFFSET, rounding="keyed").report, "z", "ess", "estimate")


def run_filter_resumed(spark, folder):
    return rounded(_resumed(spark, folder).particles, "x")


def step_report_resumed(spark, folder):
    return rounded(_resumed(spark, folder).report, "z", "ess", "estimate")


def step_report_resumed_grouped(spark, folder):
    return rounded(_resumed(spark, folder, "user_id").report, "z", "ess", "estimate")


QUERIES: dict[str, Query] = {
    "scan_keyvalue_text": scan_keyvalue_text,
    "sink_keyvalue_text": sink_keyvalue_text,
    "merge_sources": merge_sources_query,
    "id_range_source": id_range_source,
    "step_report": step_report,
    "materialize_step": materialize_step,
    "rebalance": rebalance,
    "init_particles": init_particles,
    "propagate_state": propagate_state,
    "measurement": measurement,
    "log_weight": log_weight,
    "linear_weight": linear_weight,
    "quantize_offset": quantize_offset_query,
    "node_bucket": node_bucket,
    "clamp_counts": clamp_counts,
    "keyed_noise": keyed_noise,
    "keyed_noise_by_group": keyed_noise_by_group,
    "half_filter": half_filter,
    "threshold_flag": threshold_flag,
    "negate_flag": negate_flag,
    "rekey": rekey,
    "drop_sentinel": drop_sentinel,
    "tag_and_pair": tag_and_pair,
    "range_expand": range_expand,
    "range_expand_overlapping": range_expand_overlapping,
    "join_on_id": join_on_id,
    "join_scalar": join_scalar,
    "join_node_value": join_node_value,
    "merge_by_max": merge_by_max,
    "gather_by_index": gather_by_index,
    "elementwise_combine": elementwise_combine,
    "max_weight": max_weight,
    "tree_sum": tree_sum,
    "tree_sum_by_node": tree_sum_by_node,
    "tree_sum_reproducible": tree_sum_reproducible,
    "weighted_mean_reproducible": weighted_mean_reproducible,
    "posterior_mean_reproducible": posterior_mean_reproducible,
    "log_sum_exp": log_sum_exp,
    "log_sum_exp_by_group": log_sum_exp_by_group,
    "normalize_weights": normalize_weights,
    "normalize_weights_by_group": normalize_weights_by_group,
    "normalize_weights_degenerate": normalize_weights_degenerate,
    "effective_sample_size": effective_sample_size,
    "effective_sample_size_by_group": effective_sample_size_by_group,
    "weighted_mean": weighted_mean,
    "posterior_mean": posterior_mean,
    "group_max_key": group_max_key,
    "count_rows": count_rows,
    "conditional_count": conditional_count,
    "prefix_sum": prefix_sum,
    "segmented_prefix_sum": segmented_prefix_sum,
    "exclusive_prefix": exclusive_prefix,
    "adjacent_difference": adjacent_difference,
    "adjacent_difference_by_group": adjacent_difference_by_group,
    "sort_by_copies": sort_by_copies,
    "union_all": union_all,
    "systematic_copies": systematic_copies,
    "systematic_copies_by_group": systematic_copies_by_group,
    "systematic_copies_lineitem": systematic_copies_lineitem,
    "replicate_by_count": replicate_by_count,
    "replicate_balanced": replicate_balanced,
    "resample": resample_query,
    "resample_if_needed": resample_if_needed,
    "filter_step": filter_step_query,
    "run_filter": run_filter_query,
    "run_filter_grouped": run_filter_grouped_query,
    "step_report_grouped": step_report_grouped,
    "step_report_weighted": step_report_weighted,
    "step_report_carried": step_report_carried,
    "step_report_carried_grouped": step_report_carried_grouped,
    "step_report_offset": step_report_offset,
    "run_filter_resumed": run_filter_resumed,
    "step_report_resumed": step_report_resumed,
    "step_report_resumed_grouped": step_report_resumed_grouped,
    "weight_totals": weight_totals,
    "systematic_copies_rounded": systematic_copies_rounded,
}
