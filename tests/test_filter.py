import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from murmuration import FilterSettings, Noise, StateSpaceModel, filter_step, growth_model, run_filter, run_filter_grouped
from murmuration.functions.slots import ONE_32
from murmuration.plans.filter import OFFSET_KEY, _observed
from murmuration.sources.generate import id_range

NOISE = Noise(9)
OBSERVED = [(1, 3.0), (2, 12.0), (3, 0.5), (4, 7.5), (5, 15.0)]


def population(spark, n, parts=4):
    return id_range(spark, n).withColumn("x", Noise(1).gaussian(0, "id") * F.lit(3.0)).repartition(parts)


def observations(spark, rows=OBSERVED):
    return spark.createDataFrame(rows, "step int, z double")


def draws(spark, noise, n, step):
    return [r[0] for r in spark.range(1, n + 1).orderBy("id").select(noise.gaussian(step, "id")).collect()]


def by_hand(spark, start, observed, settings, variance):
    """The filter in plain Python, on the same draws."""
    x, carried, report = list(start), [0.0] * len(start), []
    n = len(x)
    for step, z in observed:
        g = draws(spark, settings.noise, n, step)
        x = [0.5 * v + 25 * v / (1 + v * v) + 8 * math.cos(1.2 * (step - 1)) + math.sqrt(10.0) * e for v, e in zip(x, g)]
        lw = [0.0 if z is None else -math.log(math.sqrt(2 * math.pi * variance)) - (z - v * v / 20) ** 2 / (2 * variance) for v in x]
        if settings.carry_weights:
            lw = [a + b for a, b in zip(carried, lw)]
        peak = max(lw)
        wq = [math.floor(math.exp(v - peak) * 2**settings.bits + 0.5) for v in lw]
        total = sum(wq)
        ess = total**2 / sum(w * w for w in wq)
        mean = sum(w * v for w, v in zip(wq, x)) / total
        resampled = ess <= settings.fraction * n
        if resampled:
            bits = spark.range(1).select(settings.noise.bits32(step, F.lit(OFFSET_KEY))).first()[0]
            after, before = [], 0
            for w, v in zip(wq, x):
                lo = (before * n * ONE_32 + bits * total) // (total * ONE_32)
                before += w
                after += [v] * ((before * n * ONE_32 + bits * total) // (total * ONE_32) - lo)
            x, carried = after, [0.0] * n
        else:
            carried = [v - peak for v in lw]
        report.append((step, ess, resampled, mean if settings.estimate == "weighted" else sum(x) / n))
    return x, report


@pytest.mark.parametrize("estimate,carry,variance", [("plain", False, 25.0), ("weighted", True, 25.0)])
def test_filter_equals_plain_python(spark, estimate, carry, variance):
    settings = FilterSettings(growth_model(measurement_variance=variance), NOISE, estimate=estimate, carry_weights=carry)
    start = population(spark, 300)
    seen = OBSERVED[:3] + [(4, None)] + OBSERVED[4:]
    run = run_filter(start, observations(spark, seen), settings)
    x, report = by_hand(spark, [r.x for r in start.orderBy("id").collect()], seen, settings, variance)
    got = run.particles.orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 301))
    assert [r.x for r in got] == pytest.approx(x, abs=1e-8)
    rows = run.report.orderBy("step").collect()
    assert [(r.step, r.resampled) for r in rows] == [(s, f) for s, _, f, _ in report]
    assert {r.resampled for r in rows} == {True, False}
    assert [r.ess for r in rows] == pytest.approx([e for _, e, _, _ in report], rel=1e-8)
    assert [r.estimate for r in rows] == pytest.approx([m for *_, m in report], abs=1e-8)


def test_same_run_for_any_partitioning(spark, partitions):
    seen = []
    for parts in (1, 7, 32):
        partitions(parts)
        run = run_filter(population(spark, 257, parts), observations(spark, OBSERVED[:2]), FilterSettings(noise=NOISE))
        seen.append(sorted((r.id, r.x) for r in run.particles.collect()))
    assert seen[0] == seen[1] == seen[2]


def test_reading_the_result_twice_gives_the_same_states(spark):
    run = filter_step(population(spark, 100), 1, 4.0, FilterSettings(noise=NOISE))
    assert sorted(run.particles.collect()) == sorted(run.particles.collect())
    assert run.report.columns == ["step", "z", "ess", "resampled", "estimate"]


def test_one_particle_and_sparse_ids(spark):
    one = spark.createDataFrame([(77, 1.0)], "id bigint, x double")
    run = run_filter(one, observations(spark, OBSERVED[:2]), FilterSettings(noise=NOISE))
    assert [r.id for r in run.particles.collect()] == [1]
    sparse = spark.createDataFrame([(10**k, 1.0) for k in range(12)], "id bigint, x double")
    run = run_filter(sparse, observations(spark, OBSERVED[:1]), FilterSettings(noise=NOISE))
    assert sorted(r.id for r in run.particles.collect()) == list(range(1, 13))


def test_states_without_a_likelihood_get_no_weight(spark):
    broken = StateSpaceModel(
        transition=lambda x, step, noise: x,
        log_likelihood=lambda x, z: F.when(x < 0, F.lit(float("nan"))).otherwise(F.lit(0.0)),
    )
    start = spark.createDataFrame([(k, -1.0 if k % 4 else 2.0) for k in range(1, 41)], "id bigint, x double")
    run = filter_step(start, 1, 0.0, FilterSettings(broken, NOISE))
    assert {r.x for r in run.particles.collect()} == {2.0}
    hopeless = filter_step(start.where("x < 0"), 1, 0.0, FilterSettings(broken, NOISE))
    assert hopeless.report.first().resampled is False


def test_bad_input_is_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        run_filter(population(spark, 5).where("id > 9"), observations(spark))
    with pytest.raises(ValueError, match="more than one observation"):
        run_filter(population(spark, 5), observations(spark, [(1, 0.0), (1, 1.0)]))
    with pytest.raises(ValueError):
        FilterSettings(estimate="median")


def test_tracking_beats_a_run_that_never_resamples(spark):
    truth, x, seen = [], 1.0, []
    shocks = draws(spark, Noise(123), 12, 0)
    blur = draws(spark, Noise(321), 12, 0)
    for step in range(1, 13):
        x = 0.5 * x + 25 * x / (1 + x * x) + 8 * math.cos(1.2 * (step - 1)) + math.sqrt(10.0) * shocks[step - 1]
        truth.append(x)
        seen.append((step, x * x / 20 + blur[step - 1]))
    start = spark.range(1, 2001).select("id", F.lit(1.0).alias("x"))
    error = {}
    for fraction in (0.5, 0.0):
        settings = FilterSettings(noise=NOISE, fraction=fraction)
        rows = run_filter(start, observations(spark, seen), settings, 10.0).report.orderBy("step").collect()
        error[fraction] = math.sqrt(sum((r.estimate - t) ** 2 for r, t in zip(rows, truth)) / 12)
    assert error[0.5] < error[0.0]


def test_grouped_filter_with_a_hot_a_null_and_an_unobserved_group(spark, partitions):
    partitions(8)
    names = ["hot"] * 600 + ["b"] * 50 + [None] * 40 + ["blind"] * 30
    rows = [(g, 5 * k, float(k % 9) - 4) for k, g in enumerate(names)]
    start = spark.createDataFrame(rows, "g string, id bigint, x double")
    seen = [(g, s, z) for g in ("hot", "b", None) for s, z in OBSERVED[:2]] + [("nobody", 1, 0.0)]
    observed = spark.createDataFrame(seen, "g string, step int, z double")
    run = run_filter_grouped(start, observed, ["g"], FilterSettings(noise=NOISE))
    sizes = {r.g: r["count"] for r in run.particles.groupBy("g").count().collect()}
    assert sizes == {"hot": 600, "b": 50, None: 40, "blind": 30}
    for name, size in sizes.items():
        ids = sorted(r.id for r in run.particles.where(F.col("g").eqNullSafe(F.lit(name))).collect())
        assert ids == list(range(1, size + 1))
    report = run.report.collect()
    assert len(report) == 8
    assert all(not r.resampled and r.ess == r_size for r in report if r.g == "blind" for r_size in [30.0])
    assert any(r.resampled for r in report)


def test_grouped_filter_refuses_two_observations(spark):
    start = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0)], "g string, id bigint, x double")
    twice = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 1.0)], "g string, step int, z double")
    with pytest.raises(Exception, match="more than one observation"):
        run_filter_grouped(start, twice, ["g"], FilterSettings(noise=NOISE))


def bounded():
    """Particles within 10 of the observation have a weight, others none."""
    near = lambda x, z: F.when(F.abs(x - z) <= 10, -F.abs(x - z)).otherwise(F.lit(float("-inf")))
    return StateSpaceModel(lambda x, step, noise: x, near)


def test_carried_weights_recover_where_none_is_left(spark):
    ids = id_range(spark, 100)
    states = ids.withColumn("x", F.col("id").cast("double"))
    seen = observations(spark, [(1, 500.0), (2, 50.0)])
    runs = []
    for carry in (False, True):
        settings = FilterSettings(bounded(), NOISE, carry_weights=carry, estimate="weighted")
        runs.append(run_filter(states, seen, settings).report.orderBy("step").collect())
        grouped = run_filter_grouped(
            states.withColumn("g", F.lit("a")), seen.withColumn("g", F.lit("a")), ["g"], settings
        ).report.orderBy("step").collect()
        assert [r.ess for r in grouped] == pytest.approx([r.ess for r in runs[-1]])
        assert [r.estimate for r in grouped] == pytest.approx([r.estimate for r in runs[-1]], abs=0.5)
    for report in runs:
        assert report[0].ess == 100 and not report[0].resampled
        assert report[1].ess < 5 and report[1].resampled
        assert report[1].estimate == pytest.approx(50, abs=0.01)


def test_missing_states_have_no_part_in_the_mean(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id bigint, x double")
    still = StateSpaceModel(lambda x, step, noise: x, lambda x, z: x * 0.0)
    report = filter_step(rows, 1, 2.0, FilterSettings(still, NOISE)).report.first()
    assert not report.resampled and report.estimate == pytest.approx(2.0)


def test_any_number_of_observations(spark):
    many = spark.range(1, 12_001).select(F.col("id").cast("int").alias("step"), F.lit(None).cast("double").alias("z"))
    assert [s for s, _ in _observed(many)] == list(range(1, 12_001))
    with pytest.raises(ValueError, match="more than one"):
        list(_observed(many.union(many.limit(1))))


def test_concurrent_runs_leave_the_session_alone(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    states = population(spark, 200)
    want = run_filter(states, observations(spark, OBSERVED[:2]), FilterSettings(noise=NOISE)).report.orderBy("step").collect()
    with ThreadPoolExecutor(4) as pool:
        runs = list(
            pool.map(
                lambda _: run_filter(states, observations(spark, OBSERVED[:2]), FilterSettings(noise=NOISE))
                .report.orderBy("step")
                .collect(),
                range(4),
            )
        )
    assert all(r == want for r in runs)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


@pytest.mark.parametrize("ids", [[1, 1, 3], [5, 5, 6], [2, 4, 4, 90], [1, 2, 2, 4], [3, 3]])
def test_repeated_ids_are_refused(spark, ids):
    rows = spark.createDataFrame([(i, 1.0) for i in ids], "id bigint, x double")
    with pytest.raises(Exception, match="repeated"):
        filter_step(rows, 1, 0.0, FilterSettings(noise=NOISE)).particles.collect()
    grouped = rows.withColumn("g", F.lit("a"))
    seen = spark.createDataFrame([("a", 1, 0.0)], "g string, step int, z double")
    with pytest.raises(Exception, match="repeated"):
        run_filter_grouped(grouped, seen, ["g"], FilterSettings(noise=NOISE)).particles.collect()


def test_the_same_id_in_two_groups_is_not_a_repeat(spark):
    rows = spark.createDataFrame([(g, i, 1.0) for g in "ab" for i in (1, 5, 9)], "g string, id bigint, x double")
    seen = spark.createDataFrame([(g, 1, 0.0) for g in "ab"], "g string, step int, z double")
    assert run_filter_grouped(rows, seen, ["g"], FilterSettings(noise=NOISE)).particles.count() == 6


def test_a_given_offset_decides_every_resampling(spark):
    settings = [FilterSettings(noise=NOISE, fraction=1.0, offset=u) for u in (0.0, 0.0, 0.9)]
    first, again, other = (
        sorted(filter_step(population(spark, 200), 1, 3.0, s).particles.collect()) for s in settings
    )
    assert first == again and first != other
    for wrong in ({"offset": 1.0}, {"rounding": "up"}):
        with pytest.raises(ValueError):
            FilterSettings(**wrong)
