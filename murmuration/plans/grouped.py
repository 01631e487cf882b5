"""Many independent filters at once, one per group.

Every group's decision is a column of the same plan. Work is divided by cells
of (group, interval of ids), so a group that holds a third of the particles is
spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.functions.slots import effective_size, wide
from murmuration.operators.attach import attach, match_keys
from murmuration.operators.resample import replicate_balanced, slots_of, weight_sums
from murmuration.operators.scan import BUCKET, bucket_width, given_groups, lay_out, never_null, non_null_keys, row_positions
from murmuration.plans.filter import FilterRun, FilterSettings, bucket_of, log_weight
from murmuration.plans.stage import keep, materialize, materialize_observed, materialize_partitioned, run_folder, shrink, shuffle_partitions
from murmuration.plans.store import RunStore, digest_of, rows_digest


#: Observations of one step to a file, about, and facts of cells or groups to a task.
OBSERVED_ROWS = 50_000


def run_filter_grouped(
    particles: DataFrame,
    observations: DataFrame,
    group_cols: Sequence[str],
    settings: FilterSettings | None = None,
    initial_variance: float | None = None,
    store: str | None = None,
) -> FilterRun:
    """``particles`` is (groups, id, x), ``observations`` (groups, step, z).

    Ids are replaced by their rank within the group, and must not repeat there.
    A group without an observation at some step moves on unweighted. The report
    has one row per group and step. ``store`` as for ``run_filter``.
    """
    settings = settings or FilterSettings()
    noise, spark, kept = settings.noise, particles.sparkSession, None
    if store is not None:
        own = rows_digest(particles, [*group_cols, "id", "x"])
        asked = digest_of(settings=settings.spelled(), prior=initial_variance, particles=own, groups=list(group_cols))
        kept = RunStore(spark, store, asked)
    # Inside the loop a group is a pair of columns that are never NULL, so that
    # the partitioning left by one step serves the joins of the next. Noise is
    # keyed by the groups as given.
    particles, stand_ins = non_null_keys(particles, group_cols, always=True)
    observations, _ = non_null_keys(observations, group_cols, always=True)
    groups, given = list(stand_ins), given_groups(group_cols)

    # by step, so that a step reads its own observations only, and dealt by group
    # within it, so that a step of many groups is read by many tasks
    folder = run_folder(particles.sparkSession, "observations")
    each = materialize(_one_per_step(observations, groups))
    most = each.groupBy("step").count().agg(F.max("count")).first()[0] or 0
    parts = min(shuffle_partitions(particles), -(-most // OBSERVED_ROWS) or 1)
    dealt = each.withColumns({"_step": F.col("step"), "_part": F.pmod(F.xxhash64(*groups), F.lit(parts))})
    tasks = max(parts, shuffle_partitions(particles))
    dealt.repartition(tasks, "_step", "_part").drop("_part").write.partitionBy("_step").parquet(folder)
    observed = particles.sparkSession.read.parquet(folder)
    flags = [F.col(c).isNull() for c in (*groups, "z")]
    marks = F.sum(wide(F.xxhash64(*flags, *groups, "z"))).cast("string")
    per_step = materialize(observed.groupBy("step").agg(F.count(F.lit(1)), marks).orderBy("step"))
    if per_step.isEmpty():
        raise ValueError("there are no observations")

    if kept and kept.last:
        width, n_groups = kept.last["width"], kept.last["groups"]
        pop = never_null(kept.population(), groups)
    else:
        pop, width, n_groups = _start(particles, groups, given, settings, initial_variance)
    pop = pop.withColumn(BUCKET, bucket_of("id", width))

    reports = run_folder(spark, "reports") if kept is None else f"{kept.folder}/reports"
    written = [m["report"] for m in kept.done] if kept else []
    for step, n_observed, mark in per_step.toLocalIterator():
        if kept and kept.was_done(step, mark):
            continue
        now = observed.where(F.col("_step") == F.lit(step)).select(*groups, "z")
        state = settings.model.transition(F.col("x"), F.lit(step), noise.gaussian(step, *given, "id"))
        moved = attach(pop.withColumn("x", state), now, groups, "left", n_facts=n_observed)
        own = log_weight(settings.model, F.col("x"), F.col("z"))
        moved = keep(moved.withColumn("lw", F.col("lw") + own if settings.carry_weights else own))

        # Three passes over the particles: the heaviest weights, the sums of
        # each cell, and the slots. Peaks and sums are kept for later uses.
        # What a cell comes to needs no exchange, as the population lies by cells; groups
        # are put together from that, in as few tasks as its rows ask for.
        highest = F.max("_peak").alias("_peak"), F.max("z").alias("z")
        peaks = _few(moved.withColumn("_peak", F.col("lw")).groupBy(*groups, BUCKET).agg(*highest))
        peaks = _few(peaks.groupBy(*groups).agg(*highest))
        weighted = attach(moved.drop("z"), peaks.drop("z"), groups, n_facts=n_groups)
        relative = F.exp(F.col("lw") - F.col("_peak"))
        weighted = weighted.withColumn("wq", settings.integer_weight(relative, step, *given, "id"))

        offset = settings.offset_at(step, *given)
        cells = lay_out(weighted, ["id"], groups, layout="carried", width=width)
        moment = {"wx": F.col("wq").cast("double") * F.col("x")}
        sums = _few(weight_sums(cells, "wq", settings.bits, moment))
        slots = slots_of(
            cells, "wq", None, offset, "id", settings.fraction, settings.bits, dense_ids=True, sums=sums
        )
        columns = [*groups, "id", "x"]
        if settings.carry_weights:
            # a group in which no particle has weight starts again from equal ones
            again = F.col("resampled") | (F.col("_peak") == F.lit(float("-inf")))
            started = F.when(again, F.lit(0.0)).otherwise(F.col("lw") - F.col("_peak"))
            slots = slots.withColumn("lw", started)
            columns.append("lw")
        grown = replicate_balanced(
            slots.select(*columns, "slot_lo", "slot_hi"), group_cols=groups, width=width, bucket=BUCKET
        )
        pop, means = materialize_partitioned(grown.select(*columns, BUCKET), facts=lambda rows: _few(_means(rows, groups)))
        path = f"{reports}/{step:010d}"
        _report(peaks, sums, means, groups, step, settings).write.mode("overwrite").parquet(path)
        written.append(path)
        if kept:
            kept.save(step, mark, pop.drop(BUCKET), width=width, groups=n_groups, report=path)
        moved.unpersist()

    report = spark.read.parquet(*written)
    measured = [c for c in report.columns if c not in groups]
    return FilterRun(pop.select(*given, "id", "x"), report.select(*given, *measured))


def _start(
    particles: DataFrame,
    groups: Sequence[str],
    given: Sequence[Column],
    settings: FilterSettings,
    initial_variance: float | None,
) -> tuple[DataFrame, int, int]:
    """The population before the first step, rows per bucket, number of groups."""
    states = particles.select(*groups, "id", F.col("x").cast("double").alias("x"))
    ranked = row_positions(states, ["id"], "_rank", groups, layout="auto", unique=True)
    pop = ranked.select(*groups, F.col("_rank").alias("id"), "x")
    sizes = pop.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    n_groups, n = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_groups:
        raise ValueError("the population is empty")
    if initial_variance is not None:
        spread = F.sqrt(F.lit(float(initial_variance)))
        pop = pop.withColumn("x", F.col("x") + spread * settings.noise.gaussian(0, *given, "id"))
    if settings.carry_weights:
        pop = pop.withColumn("lw", F.lit(0.0))
    return pop, bucket_width(n, shuffle_partitions(particles)), n_groups


def _one_per_step(observations: DataFrame, groups: Sequence[str]) -> DataFrame:
    twice = F.raise_error(F.lit("more than one observation for a group and step")).cast("double")
    value = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max("z"))
    return observations.groupBy(*groups, F.col("step").cast("int").alias("step")).agg(value.alias("z"))


def _few(facts: DataFrame) -> DataFrame:
    """Facts of cells or groups, written by the tasks that hold the cells and read by as
    few as they ask for: an exchange of them would else open, in each of many tasks that
    hold next to nothing, a file for each of as many others."""
    written, seen = materialize_observed(facts, rows=F.count(F.lit(1)))
    return shrink(written, -(-seen["rows"] // OBSERVED_ROWS) or 1)


def _means(pop: DataFrame, groups: Sequence[str]) -> DataFrame:
    """What the mean of a group is made of, by cells."""
    return pop.groupBy(*groups, BUCKET).agg(F.sum("x").alias("_sum"), F.count("x").alias("_n"))


def _report(
    peaks: DataFrame, sums: DataFrame, means: DataFrame, groups: list[str], step: int, settings: FilterSettings
) -> DataFrame:
    """From one row per group and from those per cell."""
    total, rows = F.col("_total"), F.col("_rows")
    facts = sums.groupBy(*groups).agg(
        F.sum("rows").alias("_rows"),
        F.sum("w").alias("_total"),
        F.sum("squares").alias("_squares"),
        F.sum("wx").alias("_moment"),
    )
    facts = facts.withColumn("ess", effective_size(total, F.col("_squares"), rows))
    means = means.groupBy(*groups).agg((F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("_mean"))
    joined = match_keys(match_keys(facts, means, groups), peaks.drop("_peak"), groups)
    estimate = F.col("_mean")
    if settings.estimate == "weighted":
        estimate = F.when(total == F.lit(0), estimate).otherwise(F.col("_moment") / total.cast("double"))
    return joined.select(
        *groups,
        F.lit(step).alias("step"),
        "z",
        "ess",
        (F.col("ess") <= F.lit(settings.fraction) * rows).alias("resampled"),
        estimate.alias("estimate"),
    )
