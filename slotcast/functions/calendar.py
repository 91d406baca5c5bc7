"""Calendar features known arbitrarily far ahead."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col

# fixed values: holidays on a fixed month and day
FIXED_HOLIDAYS = ("01-01", "04-30", "05-01", "09-02")
# fixed values: lunar holiday ranges, first and last day
LUNAR_HOLIDAYS = (
    ("2021-02-10", "2021-02-16"), ("2021-04-21", "2021-04-21"),
    ("2022-01-31", "2022-02-04"), ("2022-04-10", "2022-04-10"),
    ("2023-01-20", "2023-01-26"), ("2023-04-29", "2023-04-29"),
    ("2024-02-08", "2024-02-14"), ("2024-04-18", "2024-04-18"),
    ("2025-01-27", "2025-02-02"), ("2025-04-07", "2025-04-07"),
    ("2026-02-15", "2026-02-21"), ("2026-04-26", "2026-04-26"),
)
REGIME_START_YEAR = 2023


def cyclic(value, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a position on a cycle of length ``period``."""
    angle = as_col(value) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clock_features(date: str = "date", cycle: str = "cycle") -> dict[str, Column]:
    """Hour, weekday (Monday = 0) and month positions as sine and cosine."""
    out = {}
    for name, value, period in (
        ("hour", F.col(cycle) / 2.0, 24.0),
        ("dow", F.weekday(F.col(date)), 7.0),
        ("month", F.month(F.col(date)), 12.0),
    ):
        out[f"sin_{name}"], out[f"cos_{name}"] = cyclic(value, period)
    return out


def weekend(date: str = "date", flag: str | None = None) -> Column:
    """Saturday or Sunday, or the calendar's own flag when it has one."""
    own = (F.weekday(F.col(date)) >= 5).cast("int")
    return own if flag is None else F.greatest(F.coalesce(F.col(flag).cast("int"), F.lit(0)), own)


def holiday(
    date: str = "date",
    flag: str | None = None,
    fixed=FIXED_HOLIDAYS,
    ranges=LUNAR_HOLIDAYS,
) -> Column:
    """Calendar flag, fixed date, or inside one of the (start, end) ranges."""
    tests = [f"date_format({date}, 'MM-dd') in ({', '.join(repr(d) for d in fixed)})"]
    tests += [f"{date} between date'{start}' and date'{end}'" for start, end in ranges]
    own = F.expr(" or ".join(tests)).cast("int")
    return own if flag is None else F.greatest(F.coalesce(F.col(flag).cast("int"), F.lit(0)), own)


def after_year(date: str = "date", year: int = REGIME_START_YEAR) -> Column:
    """1 from January 1st of ``year`` on."""
    return (F.year(F.col(date)) >= year).cast("int")
