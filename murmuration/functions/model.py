"""State-space models as column expressions, so a step stays in codegen."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The default model and filter settings.
PROCESS_VARIANCE = 10.0
MEASUREMENT_VARIANCE = 1.0
INITIAL_VARIANCE = 10.0
ESS_FRACTION = 0.5


@dataclass(frozen=True)
class StateSpaceModel:
    """``transition(x, step, noise)`` with standard normal noise, and
    ``log_likelihood(x, z)``; both return a Column."""

    transition: Callable[[Column, Column, Column], Column]
    log_likelihood: Callable[[Column, Column], Column]


def drift(x: Column, step: Column) -> Column:
    """The noise-free part of the growth model's transition."""
    return (
        F.lit(0.5) * x
        + F.lit(25.0) * x / (F.lit(1.0) + x * x)
        + F.lit(8.0) * F.cos(F.lit(1.2) * (step - F.lit(1)))
    )


def measurement(x: Column) -> Column:
    """h(x) = x^2 / 20."""
    return x * x / F.lit(20.0)


def gaussian_log_weight(z: Column, expected: Column, variance: float) -> Column:
    """Log density of ``z`` around ``expected``, constant term included."""
    miss = z - expected
    return F.lit(-math.log(math.sqrt(2.0 * math.pi * variance))) - miss * miss / F.lit(2.0 * variance)


def linear_weight(log_weight: Column) -> Column:
    return F.exp(log_weight)


def growth_model(
    process_variance: float = PROCESS_VARIANCE,
    measurement_variance: float = MEASUREMENT_VARIANCE,
) -> StateSpaceModel:
    """The univariate non-stationary growth model with a quadratic sensor."""
    spread = math.sqrt(process_variance)
    return StateSpaceModel(
        transition=lambda x, step, noise: drift(x, step) + F.lit(spread) * noise,
        log_likelihood=lambda x, z: gaussian_log_weight(z, measurement(x), measurement_variance),
    )
