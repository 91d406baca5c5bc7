"""Slot arithmetic on TIMESTAMP_NTZ."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.limits import CUTOFF_SLOT, STEP_MINUTES


def slot_of(ts) -> Column:
    """Half-hour slot 0..47 of a timestamp."""
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / STEP_MINUTES)).cast("int")


def slot_ts(date, cycle) -> Column:
    """Start of slot ``cycle`` on ``date``."""
    minutes = (F.col(cycle) if isinstance(cycle, str) else cycle) * STEP_MINUTES
    day = F.col(date) if isinstance(date, str) else date
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)


def floor_slot(ts) -> Column:
    """Timestamp rounded down to its half hour."""
    return slot_ts(F.to_date(ts), slot_of(ts))


def with_clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``date`` and ``cycle``."""
    return df.withColumns({"date": F.to_date(ts), "cycle": slot_of(ts)})


def before_cutoff(cutoff: int = CUTOFF_SLOT, cycle: str = "cycle") -> Column:
    """True on the slots of a day that are known at the forecast origin."""
    return F.col(cycle) <= cutoff
