"""Student t tail probability, one formula for all degrees of freedom."""

from __future__ import annotations

from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Nodes of the exp-sinh rule on (0, inf): places and weights.
_Y = np.arange(-5.0, 5.0, 1 / 32)
_PLACE = np.exp(np.pi / 2 * np.sinh(_Y))
_WEIGHT = _PLACE * np.pi / 2 * np.cosh(_Y) / 32


def _gamma_step(a: float) -> float:
    """``ln gamma(a + 1/2) - ln gamma(a)``, by Stirling's series where the two nearly cancel."""
    if a < 100:
        return lgamma(a + 0.5) - lgamma(a)
    return 0.5 * log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def log_tail(t: float | None, nu: float | None) -> float | None:
    """Natural logarithm of the two-sided p of ``t`` at ``nu`` degrees of freedom.

    The density at ``t`` times the integral of its ratio beyond ``t``, both in logarithms, so that
    relative precision, about 1e-12, does not depend on how small p is. Null without a statistic or
    below one degree of freedom.
    """
    if t is None or nu is None or np.isnan(t) or nu < 1:
        return None
    size = abs(t)
    if np.isinf(size):
        return float("-inf")
    spread = nu + size * size
    scale = 1 / ((nu + 1) * size / spread + np.sqrt((nu + 1) / spread))
    u = scale * _PLACE
    with np.errstate(over="ignore", under="ignore"):
        ratio = np.exp(-(nu + 1) / 2 * np.log1p(u * (2 * size + u) / spread))
        beyond = float((ratio * (scale * _WEIGHT)).sum())
    density = _gamma_step(nu / 2) - 0.5 * log(nu * pi) - (nu + 1) / 2 * np.log1p(size * size / nu)
    return min(0.0, float(log(2) + density + np.log(beyond)))


@F.arrow_udf(DoubleType())
def log_two_sided_p(t: pa.Array, nu: pa.Array) -> pa.Array:
    """``ln p``: one value per tested outcome, after all aggregation."""
    pairs = zip(t.to_pylist(), nu.to_pylist())
    return pa.array([log_tail(x, n) for x, n in pairs], pa.float64())


def two_sided_p(t: Column, nu: Column) -> Column:
    """Two-sided p of a t statistic with ``nu`` degrees of freedom; 0 only below 1e-308."""
    return F.exp(log_two_sided_p(t.cast("double"), nu.cast("double")))
