"""Sequential Monte Carlo on Spark DataFrames.

Weighted sampling and sequential state estimation over tables: log-domain
weights, prefix sums that scale past one partition, exact systematic
resampling, replication of rows by count, and a bootstrap filter driven by an
observation table.
"""

from murmuration.functions.model import StateSpaceModel, growth_model
from murmuration.functions.noise import Noise
from murmuration.operators.resample import resample, resample_if_needed, systematic_copies
from murmuration.operators.scan import prefix_sum
from murmuration.operators.weights import effective_sample_size, normalize_weights
from murmuration.plans.filter import FilterRun, FilterSettings, filter_step, run_filter
from murmuration.plans.grouped import run_filter_grouped

__all__ = [
    "FilterRun",
    "FilterSettings",
    "Noise",
    "StateSpaceModel",
    "effective_sample_size",
    "filter_step",
    "growth_model",
    "normalize_weights",
    "prefix_sum",
    "resample",
    "resample_if_needed",
    "run_filter",
    "run_filter_grouped",
    "systematic_copies",
]
