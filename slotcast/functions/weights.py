"""Sample and model weights."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col

ERROR_FLOOR = 25.0


def age_days(ts, newest) -> Column:
    """Days between two TIMESTAMP_NTZ values, with fraction, whatever the session zone."""
    return F.timestamp_diff("SECOND", as_col(ts), as_col(newest)) / 86400.0


def recency_weight(ts, newest, half_life_days: float) -> Column:
    """Halves every ``half_life_days`` before ``newest``."""
    return F.pow(F.lit(0.5), age_days(ts, newest) / F.lit(float(half_life_days)))


def inverse_error(mae, floor: float = ERROR_FLOOR) -> Column:
    """Unnormalised weight of a model with this mean error; the floor stops one model taking all."""
    e = as_col(mae)
    return F.when(e.isNotNull(), 1.0 / F.greatest(e, F.lit(floor)))


def class_balance(positive, negative, low: float = 1.0, high: float = 20.0) -> Column:
    """Weight of the positive class, negatives per positive, clipped."""
    p = as_col(positive)
    return F.when(p > 0, F.greatest(F.least(as_col(negative) / p, F.lit(high)), F.lit(low)))
