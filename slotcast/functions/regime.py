"""Regime gates, blends, snaps and state projection."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col, clip
from slotcast.limits import Limits


def is_clean(y, limits: Limits = Limits()) -> Column:
    """Strictly between the low and high limits."""
    y = as_col(y)
    return (y > limits.low) & (y < limits.high)


def is_low(y, limits: Limits = Limits()) -> Column:
    return as_col(y) <= limits.low


def gate_weight(probability, threshold, ramp) -> Column:
    """Weight of the low regime: off above threshold 1, else a step or a linear ramp."""
    p, t, r = as_col(probability), F.lit(threshold), F.lit(ramp)
    step = F.when(p >= t, 1.0).otherwise(0.0)
    slope = (p - (t - r)) / F.when(r > 0, 2 * r)
    ramped = F.greatest(F.least(slope, F.lit(1.0)), F.lit(0.0))
    return F.when(t > 1.0, 0.0).when(p.isNull(), None).when(r <= 0.0, step).otherwise(ramped)


def gate_blend(normal, low, weight, limits: Limits = Limits()) -> Column:
    """Normal and low forecasts mixed by the gate weight; the low one is kept in its range."""
    w = as_col(weight)
    return (1.0 - w) * as_col(normal) + w * clip(low, 0.0, limits.low)


def soft_mixture(probability, normal, low) -> Column:
    """Expectation over the two regimes."""
    p = as_col(probability)
    return (1.0 - p) * as_col(normal) + p * as_col(low)


def cap_snap(prediction, cap, ratio: float) -> Column:
    """Forecasts at or above ``ratio`` of the cap become the cap; no cap, no change."""
    p, c = as_col(prediction), as_col(cap)
    return F.when(c.isNotNull() & (p >= F.lit(ratio) * c), c).otherwise(p)


def project_states(
    prediction, weight, lower_cut, cap_cut, lower_value, cap_value, gate_limit: float = 0.20
) -> Column:
    """Snap forecasts outside the gate to the low or the cap price level.

    A NULL cut leaves that side alone.
    """
    p, w = as_col(prediction), as_col(weight)
    outside = w < gate_limit
    lowered = F.when(outside & (p <= as_lit(lower_cut)), as_lit(lower_value)).otherwise(p)
    return F.when(outside & (lowered >= as_lit(cap_cut)), as_lit(cap_value)).otherwise(lowered)


def as_lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("double")


def publishable(prediction, limits: Limits = Limits()) -> Column:
    """Final clip to the allowed price range."""
    return clip(prediction, limits.floor, limits.ceiling)
