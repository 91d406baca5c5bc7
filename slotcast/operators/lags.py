"""Same-slot lags and long rolling means."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.limits import CUTOFF_SLOT, SLOTS
from slotcast.operators.frames import along

# fixed values
LAG_DAYS = (1, 2, 3, 7, 14, 28)


def lag_days(col: str, days: int) -> Column:
    """Same slot, ``days`` days back."""
    return F.expr(_lag_sql(col, days))


def origin_safe_lag(col: str, cutoff: int = CUTOFF_SLOT) -> Column:
    """Newest same-slot value known at the origin: yesterday's up to the cutoff slot, else the day before's."""
    return F.expr(f"if(cycle <= {cutoff}, {_lag_sql(col, 1)}, {_lag_sql(col, 2)})")


def _lag_sql(col: str, days: int) -> str:
    return f"lag(`{col}`, {days}) over (partition by series_id, cycle order by date)"


def slot_lags(col: str, prefix: str, days=LAG_DAYS, cutoff: int = CUTOFF_SLOT) -> dict[str, Column]:
    """``<prefix>_<k>d`` for each k; the one-day lag is the origin-safe one."""
    return {f"{prefix}_{k}d": origin_safe_lag(col, cutoff) if k == 1 else lag_days(col, k) for k in days}


def add_lags(df: DataFrame, prefixes: dict[str, str], days=LAG_DAYS, cutoff: int = CUTOFF_SLOT) -> DataFrame:
    """Lags of many columns in one projection, hence one window and one shuffle."""
    out = {}
    for col, prefix in prefixes.items():
        if col in df.columns:
            out.update(slot_lags(col, prefix, days, cutoff))
    return df.withColumns(out) if out else df


def running_parts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Running sum and count of each column along its series, for ``rolling_mean``."""
    so_far = along().rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        out[f"__{c}_s"] = F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(so_far)
        out[f"__{c}_n"] = F.count(c).over(so_far)
    return df.withColumns(out)


def rolling_mean(col: str, days: int, shift_days: int, min_count: int) -> Column:
    """Mean of the ``days * 48`` rows that end ``shift_days`` days before the row.

    The difference of two running sums: two look-backs per row instead of a frame of
    ``days * 48`` rows. Needs ``running_parts`` on a gap-free panel.
    """
    def total(part: str) -> Column:
        newest = F.lag(f"__{col}_{part}", shift_days * SLOTS).over(along())
        before = F.lag(f"__{col}_{part}", (shift_days + days) * SLOTS).over(along())
        return newest - F.coalesce(before, F.lit(0))

    n = total("n")
    return F.when(n >= min_count, total("s") / n)


def drop_parts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])
