"""From raw, mixed-frequency sources to one gap-free panel.

A panel row is one half-hour slot of one series: ``series_id, ts, date, cycle``
and value columns. Raw sources are reduced to slots by partial aggregation before
any shuffle, so a source or series that holds a large share of the raw rows
reaches the shuffle as at most one row per slot and map task. After gridding a
series has exactly 48 rows per day, and every window here is keyed by
``(series_id, date)`` or ``(series_id, cycle)``: 48 rows, or one row per day.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.clock import floor_slot, slot_ts, with_clock
from slotcast.functions.numeric import finite
from slotcast.limits import SLOTS, STEP_MINUTES
from slotcast.operators.frames import across_days, by_day, by_slot

KEY = ["series_id", "ts"]


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``.

    A ``min_by`` aggregate, not ``row_number``: copies of a hot key are dropped
    before the shuffle instead of being sorted in one task.
    """
    return _dedup(df, keys, order, F.min_by)


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    return _dedup(df, keys, order, F.max_by)


def _dedup(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.lit(1)
    chosen = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("row"))
    return chosen.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*df.columns)


def to_slots(df: DataFrame, series: str, ts: str, **aggs: Column) -> DataFrame:
    """Irregular rows to one row per series and half hour."""
    slotted = df.withColumn("__slot", F.window(ts, f"{STEP_MINUTES} minutes")["start"])
    keys = [F.col(series).alias("series_id"), F.col("__slot").alias("ts")]
    return slotted.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def make_grid(df: DataFrame, series: str = "series_id", ts: str = "ts", whole_days: bool = False) -> DataFrame:
    """Every half hour from the first to the last row of each series.

    With ``whole_days`` the first and last day are padded to 48 slots and a boolean
    ``in_span`` marks the rows that belong to the grid proper.
    """
    lo, hi = floor_slot(F.col("lo")), floor_slot(F.col("hi"))
    span = df.groupBy(F.col(series).alias("series_id")).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    days = span.select(
        "series_id",
        lo.alias("lo"),
        hi.alias("hi"),
        F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("date"),
    )
    slots = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("cycle"))
    stamped = slots.withColumn("ts", slot_ts("date", "cycle"))
    inside = F.col("ts").between(F.col("lo"), F.col("hi"))
    if whole_days:
        return stamped.select("series_id", "ts", "date", "cycle", inside.alias("in_span"))
    return stamped.where(inside).select("series_id", "ts", "date", "cycle")


def attach(grid: DataFrame, source: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Left join of a slot-level source; ``source`` must be unique on the key."""
    on = [k for k in KEY if k in source.columns]
    cols = cols or [c for c in source.columns if c not in grid.columns]
    return grid.join(source.select(*on, *cols), on, "left")


def attach_daily(grid: DataFrame, daily: DataFrame, cols: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Left join of a date-keyed table; of several rows for a date the last by ``order`` wins.

    The join side is picked by Spark from the size of ``daily``: a small dimension is
    broadcast under ``spark.sql.autoBroadcastJoinThreshold``, a large one is not.
    """
    on = [k for k in ("series_id", "date") if k in daily.columns]
    cols = cols or [c for c in daily.columns if c not in on]
    unique = dedup_last(daily.select(*on, *dict.fromkeys([*cols, *(order or [])])), on, order or cols)
    return grid.join(unique.select(*on, *cols), on, "left")


def label_pivot(df: DataFrame, text: str, labels: dict[str, str], by: list[str], **aggs: Column) -> DataFrame:
    """One column per label and aggregate, over rows whose ``text`` contains the label's pattern.

    Patterns match case-insensitively and a row may match several labels; a missing
    text matches none. One aggregation builds every column and keeps every ``by`` key.
    """
    flags = {f"is_{name}": F.coalesce(F.lower(text).contains(p.lower()), F.lit(False)) for name, p in labels.items()}
    flagged = df.withColumns(flags).where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
    outs = []
    for name in labels:
        for suffix, value in aggs.items():
            outs.append(F.max(F.when(F.col(f"is_{name}"), value)).alias(f"{name}_{suffix}"))
    return flagged.groupBy(*by).agg(*outs)


def plant_rollup(df: DataFrame, source: str, ts: str, sums: list[str], means: list[str], prefix: str = "hydro_") -> DataFrame:
    """Two levels: sum flows and average levels per source and time, then average over sources."""
    per_source = df.groupBy(source, ts).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]
    )
    return per_source.groupBy(ts).agg(*[F.avg(c).alias(prefix + c) for c in [*sums, *means]])


def upsample_ffill(hourly: DataFrame, cols: list[str], keys: list[str] = []) -> DataFrame:
    """Coarser-than-slot rows to half hours by carrying the last value forward.

    The grid ends half an hour after the last row. Keys are the series, if any.
    """
    one = hourly if keys else hourly.withColumn("series_id", F.lit("all"))
    if keys and keys != ["series_id"]:
        raise ValueError("upsample_ffill takes no key or series_id")
    ends = one.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ends = ends.select("series_id", F.explode(F.array("a", F.col("b") + F.expr("interval 30 minutes"))).alias("ts"))
    grid = attach(make_grid(ends, whole_days=True), one, cols)
    filled = forward_fill(grid, cols, whole_days=True).where("in_span").drop("in_span")
    return filled if keys else filled.drop("series_id")


def season_fill(df: DataFrame, cols: list[str], days: int = 7) -> DataFrame:
    """Missing values take the original value of the same slot ``days`` back."""
    return df.withColumns({c: F.coalesce(c, F.lag(c, days).over(by_slot())) for c in cols})


def forward_fill(df: DataFrame, cols: list[str], whole_days: bool = False) -> DataFrame:
    """Last known value of the series.

    ``whole_days`` says that every day present has its 48 rows. The fill then runs in
    two levels that never bring a series together: inside a day over its 48 slots, and
    across days per slot over one row a day, where a day inherits the last value of any
    earlier day. Without that promise one window per series is used.
    """
    if not whole_days:
        w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    up_to_now = by_day().rowsBetween(Window.unboundedPreceding, 0)
    whole_day = by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_slot().rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({
        **{f"__in_{c}": F.last(c, ignorenulls=True).over(up_to_now) for c in cols},
        **{f"__day_{c}": F.last(c, ignorenulls=True).over(whole_day) for c in cols},
    })
    out = inside.withColumns({
        c: F.coalesce(F.col(f"__in_{c}"), F.last(f"__day_{c}", ignorenulls=True).over(earlier)) for c in cols
    })
    return out.select(*df.columns)


def impute(
    df: DataFrame, cols: list[str], season_days: int = 7, observed: str | None = "y", whole_days: bool = False
) -> DataFrame:
    """Seasonal fill, then forward fill; ``<observed>_observed`` keeps what was really there."""
    if observed in cols:
        df = df.withColumn(f"{observed}_observed", finite(observed).isNotNull())
    clean = df.withColumns({c: finite(c) for c in cols})
    return forward_fill(season_fill(clean, cols, season_days), cols, whole_days)


def build_panel(
    raw: DataFrame, series: str, ts: str, season_days: int = 7, impute_cols=("y",), observed: str = "y", **aggs: Column
) -> DataFrame:
    """Grid, slot aggregates and imputation of one event-like source, on day rows.

    Equal to ``make_grid``, ``to_slots``, ``attach`` and ``impute`` in turn, but the raw
    rows are read once and shuffled as slots, days and series: the grid comes from the gap
    to a series' next day instead of a join, and both fills work on 48-slot arrays, so the
    panel is sorted as one row per day. The result stays partitioned by series, which
    later windows and groupings on the series and more reuse.
    """
    slots = with_clock(to_slots(raw.dropna(subset=[series, ts]), series, ts, **aggs))
    values = F.struct(*[finite(c).alias(c) if c in impute_cols else F.col(c) for c in aggs])
    days = slots.groupBy("series_id", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("cycle", values))).alias("m"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    w = across_days()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = days.select(
        "series_id", "date", "m", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")).alias("until"),
    )
    dense = spans.select("*", F.explode(F.sequence("date", "until")).alias("day"))
    dense = dense.withColumn("__rows", F.expr(f"transform(sequence(0, {SLOTS - 1}), __s -> if(day = date, m[__s], null))"))
    dense = dense.select("series_id", F.col("day").alias("date"), "lo", "hi", *[F.col(f"__rows.{c}").alias(c) for c in aggs])
    if observed in aggs:
        dense = dense.withColumn("__seen", F.col(observed))
    seasoned = dense.withColumns({
        c: F.expr(f"""zip_with(`{c}`, coalesce(lag(`{c}`, {season_days}) over (partition by series_id order by date),
            array_repeat(null, {SLOTS})), (__v, __s) -> coalesce(__v, __s))""") for c in impute_cols
    })
    known = seasoned.withColumns({f"__k_{c}": F.expr(f"filter(`{c}`, __v -> __v is not null)") for c in impute_cols})
    carried = known.withColumns({
        f"__last_{c}": F.last(F.get(f"__k_{c}", F.size(f"__k_{c}") - 1), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        ) for c in impute_cols
    })
    filled = carried.withColumns({
        c: F.expr(f"""if(size(`__k_{c}`) = {SLOTS}, `{c}`, transform(`{c}`, (__v, __i) -> coalesce(
            __v, get(reverse(filter(slice(`{c}`, 1, __i + 1), __u -> __u is not null)), 0), `__last_{c}`)))""") for c in impute_cols
    })
    seen = ["__seen"] if observed in aggs else []
    zipped = filled.withColumn("cycle", F.sequence(F.lit(0), F.lit(SLOTS - 1)))
    rows = zipped.select("series_id", "date", "lo", "hi", F.inline(F.arrays_zip("cycle", *aggs, *seen)))
    rows = rows.withColumn("ts", slot_ts("date", "cycle")).where(F.col("ts").between(F.col("lo"), F.col("hi")))
    flags = [F.col("__seen").isNotNull().alias(f"{observed}_observed")] if seen else []
    return rows.select("series_id", "ts", "date", "cycle", *aggs, *flags)


__all__ = [
    "attach", "attach_daily", "build_panel", "dedup_first", "dedup_last", "forward_fill",
    "impute", "label_pivot", "make_grid", "plant_rollup", "season_fill", "to_slots",
    "upsample_ffill", "with_clock",
]
