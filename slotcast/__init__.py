"""Day-ahead panel analytics on Spark: every series of a half-hourly panel at once."""

from slotcast.limits import Limits

__all__ = ["Limits"]
