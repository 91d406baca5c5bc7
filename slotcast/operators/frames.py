"""Window specs of the panel. Functions, as a spec belongs to the running session."""

from pyspark.sql import Window, WindowSpec


def by_slot() -> WindowSpec:
    """One slot of a series across days: one row per day."""
    return Window.partitionBy("series_id", "cycle").orderBy("date")


def by_day() -> WindowSpec:
    """One day of a series: 48 rows."""
    return Window.partitionBy("series_id", "date").orderBy("cycle")


def across_days(*keys: str) -> WindowSpec:
    """Day rows of a series, or of a series and further keys."""
    return Window.partitionBy("series_id", *keys).orderBy("date")


def along() -> WindowSpec:
    """All slots of a series in time order: 48 rows a day, so its length is that of the calendar."""
    return Window.partitionBy("series_id").orderBy("ts")
