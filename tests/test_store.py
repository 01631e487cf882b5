"""Runs that are kept step by step and go on after a break."""

import pytest
from pyspark.sql import functions as F

from murmuration import FilterSettings, Noise, growth_model, run_filter, run_filter_grouped
from murmuration.__main__ import main
from murmuration.plans import filter as single, grouped
from murmuration.plans.store import RunStore
from murmuration.sources.generate import id_range

NOISE = Noise(5)
SEEN = [(1, 3.0), (2, None), (3, 0.5), (4, 7.5), (5, 15.0)]


class Broken(Exception):
    pass


def population(spark, n=120):
    return id_range(spark, n).withColumn("x", Noise(1).gaussian(0, "id") * F.lit(3.0))


def observations(spark, rows=SEEN):
    return spark.createDataFrame(rows, "step int, z double")


def result(run, *keys):
    return sorted(map(tuple, run.particles.collect()), key=str), sorted(map(tuple, run.report.collect()), key=str)


def close(got, want):
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert list(x) == pytest.approx(list(y), nan_ok=True)


@pytest.mark.parametrize("more", [{}, {"carry_weights": True, "estimate": "weighted"}, {"rounding": "keyed", "bits": 20}])
def test_a_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, more):
    settings = FilterSettings(growth_model(measurement_variance=25.0), NOISE, **more)
    start, seen, folder = population(spark), observations(spark), str(tmp_path / "run")
    want = result(run_filter(start, seen, settings, 10.0))
    plain, calls = single._advance, []

    def breaking(pop, step, z, settings):
        calls.append(step)
        if calls == [1, 2, 3, 4]:
            raise Broken
        return plain(pop, step, z, settings)

    monkeypatch.setattr(single, "_advance", breaking)
    with pytest.raises(Broken):
        run_filter(start, seen, settings, 10.0, folder)
    close(result(run_filter(start, seen, settings, 10.0, folder)), want)
    assert calls == [1, 2, 3, 4, 4, 5]
    close(result(run_filter(start, seen, settings, 10.0, folder)), want)  # nothing is left to do
    assert len(list((tmp_path / "run" / "populations").iterdir())) == 1
    assert not [p for p in (tmp_path / "run" / "steps").iterdir() if p.name.startswith("_")]


def test_a_step_without_its_manifest_is_done_again(spark, tmp_path, monkeypatch):
    settings, folder = FilterSettings(noise=NOISE), str(tmp_path / "run")
    start, seen = population(spark), observations(spark, SEEN[:3])
    want = result(run_filter(start, seen, settings))

    def lost(self, name, text):
        raise Broken

    commit = RunStore._commit
    run_filter(start, seen.where("step < 3"), settings, store=folder)
    monkeypatch.setattr(RunStore, "_commit", lost)
    with pytest.raises(Broken):
        run_filter(start, seen, settings, store=folder)
    monkeypatch.setattr(RunStore, "_commit", commit)
    close(result(run_filter(start, seen, settings, store=folder)), want)


@pytest.mark.parametrize("carry", [False, True])
def test_a_grouped_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, carry):
    names = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "k long, g string")
    start = population(spark).withColumn("k", F.col("id") % 3).join(names, "k").drop("k")
    seen = observations(spark).crossJoin(names.drop("k"))
    settings = FilterSettings(growth_model(measurement_variance=25.0), NOISE, carry_weights=carry)
    want = result(run_filter_grouped(start, seen, ["g"], settings, 10.0))
    plain, folder = grouped._report, str(tmp_path / "run")

    def breaking(peaks, sums, pop, groups, step, settings):
        if step == 4:
            raise Broken
        return plain(peaks, sums, pop, groups, step, settings)

    monkeypatch.setattr(grouped, "_report", breaking)
    with pytest.raises(Broken):
        run_filter_grouped(start, seen, ["g"], settings, 10.0, folder)
    monkeypatch.setattr(grouped, "_report", plain)
    close(result(run_filter_grouped(start, seen, ["g"], settings, 10.0, folder)), want)


def test_a_folder_of_another_run_is_refused(spark, tmp_path):
    start, folder = population(spark, 20), str(tmp_path / "run")
    run_filter(start, observations(spark, SEEN[:2]), FilterSettings(noise=NOISE), store=folder)
    for other in (FilterSettings(noise=Noise(6)), FilterSettings(growth_model(1.0), NOISE), FilterSettings(noise=NOISE, fraction=0.4)):
        with pytest.raises(ValueError, match="other particles or settings"):
            run_filter(start, observations(spark), other, store=folder)
    with pytest.raises(ValueError, match="other particles or settings"):
        run_filter(population(spark, 21), observations(spark), FilterSettings(noise=NOISE), store=folder)
    for changed in ([(1, 3.0), (2, 0.25)], [(0, 1.0), *SEEN]):
        with pytest.raises(ValueError, match="has changed|was not observed"):
            run_filter(start, observations(spark, changed), FilterSettings(noise=NOISE), store=folder)


def test_command_line_reads_and_writes_parquet_and_goes_on(spark, tmp_path):
    start, seen = population(spark, 30), observations(spark, SEEN[:3])
    start.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "particles"))
    seen.where("step < 3").write.parquet(str(tmp_path / "first"))
    seen.write.parquet(str(tmp_path / "all"))
    rest = ["--format", "parquet", "--seed", "5", "--store", str(tmp_path / "run"), "--offset", "0.25"]
    for part in ("first", "all"):
        main([str(tmp_path / "particles"), str(tmp_path / part), str(tmp_path / f"out-{part}"), *rest])
    got = spark.read.parquet(str(tmp_path / "out-all" / "report")), spark.read.parquet(str(tmp_path / "out-all" / "particles"))
    want = run_filter(start, seen, FilterSettings(noise=Noise(5), offset=0.25), 10.0)
    close(([tuple(r) for r in got[0].orderBy("step").collect()],), ([tuple(r) for r in want.report.orderBy("step").collect()],))
    close(([tuple(r) for r in got[1].orderBy("id").collect()],), ([tuple(r) for r in want.particles.orderBy("id").collect()],))
