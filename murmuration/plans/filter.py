"""The bootstrap filter: one population driven by a table of observations.

A step moves and weighs the particles in one narrow pass, measures the weights,
and resamples only where the effective sample size asks for it. Two scalars per
step reach the driver; the particles never do. Buckets of new ids come out of
the resampling shuffle already partitioned for the next step's prefix sum, so a
resampled step shuffles the particles once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.functions.model import ESS_FRACTION, StateSpaceModel, growth_model
from murmuration.functions.noise import Noise
from murmuration.functions.slots import WEIGHT_BITS, effective_size, floor_div, offset_bits, quantize, wide
from murmuration.operators.resample import replicate_balanced, slots_of, weight_sums
from murmuration.operators.scan import BUCKET, bucket_width, lay_out, row_positions
from murmuration.operators.vector import init_particles, propagate_state
from murmuration.plans.report import step_report
from murmuration.plans.stage import keep, materialize, materialize_partitioned, shuffle_partitions, write_cached
from murmuration.plans.store import RunStore, digest_of, rows_digest

ESTIMATES = ("plain", "weighted")
ROUNDINGS = ("nearest", "keyed")
OFFSET_KEY = "offset"
ROUNDING_KEY = "rounding"


@dataclass(frozen=True)
class FilterRun:
    """The final population and one report row per step."""

    particles: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class FilterSettings:
    """``fraction``: resample at or below this share of the population size.
    ``estimate``: mean of the new population, or weighted mean before it.
    ``carry_weights``: multiply weights over steps that do not resample, instead
    of starting each step from equal weights. ``offset``: where in its slot every
    resampling starts, in [0, 1); drawn for each step where it is not given.
    ``rounding``: integer weights are the nearest ones, or ``keyed``: rounded up by
    a draw for each particle and step, so that all weights keep their value on
    average, however light."""

    model: StateSpaceModel = field(default_factory=growth_model)
    noise: Noise = Noise(0)
    fraction: float = ESS_FRACTION
    estimate: str = "plain"
    carry_weights: bool = False
    bits: int = WEIGHT_BITS
    offset: float | None = None
    rounding: str = "nearest"

    def __post_init__(self) -> None:
        if self.estimate not in ESTIMATES:
            raise ValueError(f"estimate must be one of {ESTIMATES}")
        if self.rounding not in ROUNDINGS:
            raise ValueError(f"rounding must be one of {ROUNDINGS}")
        if self.offset is not None:
            offset_bits(self.offset)

    def spelled(self) -> list[str]:
        """All that a result depends on, as text; of the model, its expressions."""
        x, step, z, noise = (F.col(f"_{name}") for name in ("x", "step", "z", "noise"))
        model = self.model.transition(x, step, noise), self.model.log_likelihood(x, z)
        rest = [getattr(self, f.name) for f in fields(self) if f.name != "model"]
        return [str(part) for part in (*model, *rest)]

    def offset_at(self, step: int, *groups: Column) -> Column:
        """The offset of a step, and group, as 32 bits."""
        if self.offset is not None:
            return F.lit(offset_bits(self.offset))
        return self.noise.bits32(step, F.lit(OFFSET_KEY), *groups)

    def integer_weight(self, relative: Column, step: int, *keys: Column | str) -> Column:
        """A weight relative to the largest, as an integer."""
        draw = self.noise.uniform(step, F.lit(ROUNDING_KEY), *keys) if self.rounding == "keyed" else None
        return quantize(relative, self.bits, draw)


@dataclass
class _Population:
    rows: DataFrame
    width: int


def log_weight(model: StateSpaceModel, x: Column, z: Column) -> Column:
    """Log-likelihood; no weight for a state that gives no number, equal
    weights where there is no observation. An infinite likelihood is refused."""
    nothing = F.lit(float("-inf"))
    found = F.coalesce(F.nanvl(model.log_likelihood(x, z), nothing), nothing)
    refused = F.raise_error(F.lit("a likelihood is infinite")).cast("double")
    return F.when(z.isNull(), F.lit(0.0)).when(found == F.lit(float("inf")), refused).otherwise(found)


def bucket_of(id_col: str, width: int) -> Column:
    return floor_div(F.col(id_col) - F.lit(1), width)


def _prepare(particles: DataFrame, settings: FilterSettings) -> _Population:
    """Ids 1..n; other unique ids are replaced by their rank. Repeated ids are
    refused: as many ids as their span are each there once if their hashes add up
    to those of the span, and ranks are given by a window that sees neighbours."""
    rows = particles.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"))
    spread = F.sum(wide(F.xxhash64("id")))
    low, high, n, ids = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1)), spread).first()
    if n == 0:
        raise ValueError("the population is empty")
    if low is not None and high - low + 1 == n:
        if ids != particles.sparkSession.range(low, high + 1).agg(spread).first()[0]:
            raise ValueError("an id of the population is repeated")
        rows = rows.withColumn("id", F.col("id") - F.lit(low - 1))
    else:
        ranked = row_positions(rows, ["id"], "_rank", layout="auto", unique=True)
        rows = ranked.select(F.col("_rank").alias("id"), "x")
    width = bucket_width(n, shuffle_partitions(rows))
    rows = rows.withColumn(BUCKET, bucket_of("id", width))
    if settings.carry_weights:
        rows = rows.withColumn("lw", F.lit(0.0))
    return _Population(rows, width)


def _advance(pop: _Population, step: int, z: float | None, settings: FilterSettings):
    """One step; returns the next population and its report row."""
    rows = pop.rows
    moved = propagate_state(rows, settings.model, settings.noise, step)
    own = log_weight(settings.model, F.col("x"), F.lit(z).cast("double"))
    moved = moved.withColumn("lw", F.col("lw") + own if settings.carry_weights else own)
    moved = keep(moved)

    peak = moved.agg(F.max("lw")).first()[0]
    weighted = moved.withColumn("wq", settings.integer_weight(F.exp(F.col("lw") - F.lit(peak)), step, "id"))
    cells = lay_out(weighted, ["id"], layout="carried", width=pop.width)
    moments = {
        "x": F.col("x"),
        "known": F.col("x").isNotNull().cast("bigint"),
        "wx": F.col("wq").cast("double") * F.col("x"),
    }
    sums = materialize(weight_sums(cells, "wq", settings.bits, moments))
    n, total, ess, mean, moment = sums.agg(
        F.sum("rows"),
        F.sum("w").cast("double"),
        effective_size(F.sum("w"), F.sum("squares"), F.sum("rows")),
        F.sum("x") / F.nullif(F.sum("known"), F.lit(0).cast("bigint")),
        F.sum("wx"),
    ).first()
    resampled = ess <= settings.fraction * n

    if resampled:
        slots = slots_of(
            cells, "wq", None, settings.offset_at(step), "id", weight_bits=settings.bits, dense_ids=True, sums=sums
        ).select("id", "x", "slot_lo", "slot_hi")
        after = replicate_balanced(slots, width=pop.width, bucket=BUCKET).select("id", "x", BUCKET)
        if settings.carry_weights:
            after = after.withColumn("lw", F.lit(0.0))
        after, (_, mean) = materialize_partitioned(after, F.avg("x"))
    elif settings.carry_weights:
        # where no particle has any weight left, all start again from equal ones
        left = F.col("lw") - F.lit(peak) if peak > float("-inf") else F.lit(0.0)
        after = write_cached(moved.withColumn("lw", left))
    else:
        after = write_cached(moved.drop("lw"))
    moved.unpersist()

    estimate = mean
    if settings.estimate == "weighted" and total:
        estimate = moment / total
    return _Population(after, pop.width), (step, z, ess, bool(resampled), estimate)


def _observed(observations: DataFrame) -> Iterator[tuple[int, float | None]]:
    """The observations in order; the driver holds a partition of them at a time."""
    rows = observations.select(F.col("step").cast("int").alias("step"), F.col("z").cast("double").alias("z"))
    ordered = materialize(rows.orderBy("step"))
    before = None
    for row in ordered.toLocalIterator():
        if row.step == before:
            raise ValueError("more than one observation for a step")
        before = row.step
        yield row.step, row.z


def filter_step(
    particles: DataFrame, step: int, z: float | None, settings: FilterSettings | None = None
) -> FilterRun:
    """Move, weigh, resample if needed and estimate, for one observation."""
    settings = settings or FilterSettings()
    after, row = _advance(_prepare(particles, settings), step, z, settings)
    return FilterRun(after.rows.drop(BUCKET, "lw"), step_report(particles.sparkSession, [row]))


def run_filter(
    particles: DataFrame,
    observations: DataFrame,
    settings: FilterSettings | None = None,
    initial_variance: float | None = None,
    store: str | None = None,
) -> FilterRun:
    """Run the filter over every observation, in order of ``step``.

    ``particles`` is ``(id, x)``; with ``initial_variance`` the prior is drawn
    around ``x`` first. ``observations`` is ``(step, z)``, one row per step.
    ``store`` names a folder that keeps every finished step: a run that broke off
    there, or that has more observations now, goes on after its last step.
    """
    settings = settings or FilterSettings()
    kept = None
    if store is not None:
        asked = digest_of(settings=settings.spelled(), prior=initial_variance, particles=rows_digest(particles, ["id", "x"]))
        kept = RunStore(particles.sparkSession, store, asked)
    if kept and kept.last:
        width = kept.last["width"]
        pop = _Population(kept.population().withColumn(BUCKET, bucket_of("id", width)), width)
    else:
        pop = _prepare(particles, settings)
        if initial_variance is not None:
            pop.rows = init_particles(pop.rows, settings.noise, initial_variance)
    report = [tuple(m["report"]) for m in kept.done] if kept else []
    for step, z in _observed(observations):
        if kept and kept.was_done(step, z):
            continue
        pop, row = _advance(pop, step, z, settings)
        report.append(row)
        if kept:
            kept.save(step, z, pop.rows.drop(BUCKET), width=pop.width, report=row)
    return FilterRun(pop.rows.drop(BUCKET, "lw"), step_report(particles.sparkSession, report))
