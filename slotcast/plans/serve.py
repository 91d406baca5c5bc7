"""Day-ahead serving: extend the panel past the origin, make features, check them, forecast one day."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.limits import SLOTS
from slotcast.operators import policy
from slotcast.operators.panel import attach_daily
from slotcast.plans.features import FeatureSpec, add_features
from slotcast.sources.shared import settle

HISTORY_DAYS = 70
# the longest stretch that is no parameter: rain over 30 days, a day back
RAIN_DAYS = 31


def look_back_days(spec: FeatureSpec) -> int:
    """Days before a day that its features can reach."""
    return max(RAIN_DAYS, spec.quantile_days, *spec.lag_days, *spec.weekly, *spec.load_forecast) + 2


def origin_ts(origin_date, cutoff: int) -> Column:
    """Newest slot known on the origin day."""
    return F.lit(str(origin_date)).cast("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(cutoff * 30))


def future_frame(
    panel: DataFrame, origin_date, calendar: DataFrame | None = None, carry=("disp_",), y: str = "smp_system_price", cutoff: int = 15
) -> DataFrame:
    """The panel cut at the origin, empty rows up to midnight and the 48 rows of the next day.

    Columns that start with ``carry`` keep their last value on the target day; calendar
    columns come from ``calendar``; everything else is missing.
    """
    day = F.lit(str(origin_date)).cast("date")
    past = panel.where(F.col("ts") <= origin_ts(origin_date, cutoff))
    carried = [c for c in panel.columns if c.startswith(tuple(carry))]
    newest = F.max_by(F.struct(*carried), "ts") if carried else F.max("ts")
    last = past.groupBy("series_id").agg(newest.alias("__last"))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    target = last.select(
        "series_id", F.date_add(day, 1).alias("date"), F.explode(slots).alias("cycle"),
        *[F.col("__last")[c].alias(c) for c in carried],
    )
    gap = last.select("series_id", day.alias("date"), F.explode(slots).alias("cycle")).where(F.col("cycle") > cutoff)
    if calendar is not None:
        target = attach_daily(target, calendar)
    ahead = gap.unionByName(target, allowMissingColumns=True)
    ahead = ahead.withColumn("ts", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("cycle") * 30))
    kept = [c for c in ahead.columns if c in panel.columns]
    return past.unionByName(ahead.select(*kept), allowMissingColumns=True)


def split_day(full: DataFrame, features: list[str], origin_date, y: str, history_days: int = HISTORY_DAYS) -> tuple[DataFrame, DataFrame]:
    """(target, history): the day after the origin, and complete rows of the days before the origin day."""
    day = F.lit(str(origin_date)).cast("date")
    target = full.where(F.col("date") == F.date_add(day, 1))
    recent = full.where((F.col("date") < day) & (F.col("date") >= F.date_sub(day, history_days)))
    return target, recent.dropna(subset=[y, *features])


def forecast_day(
    panel: DataFrame, model, origin_date, calendar: DataFrame | None = None, spec: FeatureSpec = FeatureSpec(), check: bool = True
) -> DataFrame:
    """``series_id, ts, cycle, pred, prob, alert`` for the day after ``origin_date``.

    Reads the panel no further back than the features of its history reach. Raises when the history is stale or a
    feature of the target day is missing.
    """
    if check:
        policy.require_fresh(panel, origin_ts(origin_date, spec.cutoff), spec.y)
    origin = F.lit(str(origin_date)).cast("date")
    needed = panel.where(F.col("date") >= F.date_sub(origin, HISTORY_DAYS + look_back_days(spec)))
    full = add_features(future_frame(needed, origin_date, calendar, y=spec.y, cutoff=spec.cutoff), spec)
    recent = F.col("date") >= F.date_sub(origin, HISTORY_DAYS)
    used = dict.fromkeys(["series_id", "ts", "date", "cycle", spec.y, *model.inputs])
    full = settle(full.where(recent).select(*used), "day-ahead")
    target, history = split_day(full, model.features, origin_date, spec.y)
    if check:
        policy.require_complete(target, model.features)
    out = model.day_ahead(target, history)
    if "prob" not in out.columns:
        out = out.withColumn("prob", F.lit(0.0))
    threshold = model.regime.threshold if getattr(model, "regime", None) else 1.1
    return out.select("series_id", "ts", "cycle", "pred", "prob", (F.col("prob") >= threshold).alias("alert"))
