"""Run the filter on files: text of ``key,value`` lines, or Parquet.

    spark-submit --py-files <zip of murmuration> -m murmuration PARTICLES OBSERVATIONS OUTPUT

PARTICLES has lines ``id,state``, OBSERVATIONS lines ``step,z``; with ``--format
parquet`` columns (id, x) and (step, z). The final states and the report go to
OUTPUT/particles and OUTPUT/report, in the same format. With ``--store FOLDER`` every
step is kept there, and the same command goes on after the last one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from murmuration.functions import model as models
from murmuration.functions.noise import HASHES, Noise
from murmuration.plans.filter import ESTIMATES, ROUNDINGS, FilterSettings, run_filter
from murmuration.sources.keyvalue import read_keyvalue, read_vector, write_keyvalue


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="murmuration")
    parser.add_argument("particles")
    parser.add_argument("observations")
    parser.add_argument("output")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--hash", choices=HASHES, default=HASHES[0])
    parser.add_argument("--process-variance", type=float, default=models.PROCESS_VARIANCE)
    parser.add_argument("--measurement-variance", type=float, default=models.MEASUREMENT_VARIANCE)
    parser.add_argument("--initial-variance", type=float, default=models.INITIAL_VARIANCE)
    parser.add_argument("--fraction", type=float, default=models.ESS_FRACTION)
    parser.add_argument("--estimate", choices=ESTIMATES, default=ESTIMATES[0])
    parser.add_argument("--carry-weights", action="store_true")
    parser.add_argument("--offset", type=float)
    parser.add_argument("--rounding", choices=ROUNDINGS, default=ROUNDINGS[0])
    parser.add_argument("--format", choices=("text", "parquet"), default="text")
    parser.add_argument("--store")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("murmuration").getOrCreate()
    settings = FilterSettings(
        models.growth_model(options.process_variance, options.measurement_variance),
        Noise(options.seed, options.hash),
        options.fraction,
        options.estimate,
        options.carry_weights,
        offset=options.offset,
        rounding=options.rounding,
    )
    text = options.format == "text"
    read = read_keyvalue if text else read_vector
    particles = read(spark, options.particles)
    observations = read(spark, options.observations, "step INT, z DOUBLE")
    run = run_filter(particles, observations, settings, options.initial_variance, options.store)
    report = run.report.coalesce(1).write.mode("errorifexists")
    if text:
        write_keyvalue(run.particles, f"{options.output}/particles")
        report.option("header", True).csv(f"{options.output}/report")
    else:
        run.particles.select("id", "x").write.mode("errorifexists").parquet(f"{options.output}/particles")
        report.parquet(f"{options.output}/report")


if __name__ == "__main__":
    main()
