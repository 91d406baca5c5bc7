"""Value thresholds shared by the operators."""

from dataclasses import dataclass

SLOTS = 48
STEP_MINUTES = 30
CUTOFF_SLOT = 15


@dataclass(frozen=True)
class Limits:
    """Regime and clipping thresholds, in the unit of the target.

    ``low`` closes the low-price regime, ``(low, high)`` is the clean band and
    ``[floor, ceiling]`` is the range every published forecast is clipped to.
    """

    # fixed values
    low: float = 500.0
    high: float = 2500.0
    floor: float = 0.0
    ceiling: float = 1778.6
