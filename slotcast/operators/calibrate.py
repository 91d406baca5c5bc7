"""Corrections that walk forward day by day: trailing blend, bias and cap.

What a day may use is a range of earlier days of its series, so the walk is a window
ordered by day number and needs no loop and no state. Spark evaluates such a frame once
per day, as its rows share it, and a panel partitioned by series is not shuffled for it.

``reveal_lag_days`` is the age in days of the newest day whose actuals may be used.
2 is safe at an origin inside the day before the target; 1 assumes that the whole
day before the target is known.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.numeric import dot, sorted_quantile
from slotcast.functions.regime import cap_snap, is_clean, publishable
from slotcast.functions.weights import inverse_error
from slotcast.limits import Limits, SLOTS
from slotcast.operators.frames import across_days
from slotcast.operators.panel import dedup_last


def calendar_days(days: int, newest: int):
    """Window over day rows: the ``days`` calendar days that end ``newest`` days back."""
    w = Window.partitionBy("series_id").orderBy(F.unix_date("date"))
    return w.rangeBetween(-(days + newest - 1), -newest)


def blend_weights(
    df: DataFrame,
    models: list[str],
    y: str = "y",
    lookback_days: int = 28,
    reveal_lag_days: int = 2,
    min_rows: int = SLOTS,
    limits: Limits = Limits(),
) -> DataFrame:
    """Per series and day: one weight per model from its clean error over the trailing days.

    Fewer than ``min_rows`` clean rows give equal weights. Models are columns, so all of
    them share one aggregation and one window.
    """
    clean = is_clean(y, limits)
    days = df.groupBy("series_id", "date").agg(
        F.count_if(clean).alias("__n"),
        *[F.sum(F.when(clean, F.abs(F.col(y) - F.col(m)))).alias(f"__e_{m}") for m in models],
    )
    w = calendar_days(lookback_days, reveal_lag_days)
    n = F.sum("__n").over(w)
    inv = days.select(
        "series_id", "date", n.alias("__n"),
        *[inverse_error(F.sum(f"__e_{m}").over(w) / F.when(n > 0, n)).alias(f"__i_{m}") for m in models],
    )
    total = reduce(lambda a, b: a + b, [F.col(f"__i_{m}") for m in models])
    enough = F.coalesce(F.col("__n"), F.lit(0)) >= min_rows
    return inv.select(
        "series_id", "date",
        *[F.when(enough, F.col(f"__i_{m}") / total).otherwise(F.lit(1.0 / len(models))).alias(f"w_{m}") for m in models],
    )


def trailing_blend(
    df: DataFrame,
    models: list[str],
    out: str = "blend",
    y: str = "y",
    lookback_days: int = 28,
    reveal_lag_days: int = 2,
    min_rows: int = SLOTS,
    limits: Limits = Limits(),
) -> DataFrame:
    """Models mixed each day with the weights earned on the days before it.

    The weights of ``blend_weights``, taken over the panel rows themselves: no day table
    and no join.
    """
    clean = is_clean(y, limits)
    w = calendar_days(lookback_days, reveal_lag_days)
    errors = {f"__e_{m}": F.avg(F.when(clean, F.abs(F.col(y) - F.col(m)))).over(w) for m in models}
    staged = df.withColumns({**errors, "__n": F.count_if(clean).over(w)})
    inverse = {m: inverse_error(f"__e_{m}") for m in models}
    total = reduce(lambda a, b: a + b, inverse.values())
    mixed = reduce(lambda a, b: a + b, [F.col(m) * inverse[m] for m in models]) / total
    equal = dot(models, [F.lit(1.0 / len(models))] * len(models))
    enough = F.coalesce(F.col("__n"), F.lit(0)) >= min_rows
    return staged.withColumn(out, F.when(enough, mixed).otherwise(equal)).drop("__n", *errors)


def component_weights(df: DataFrame, models: list[str], y: str = "y", limits: Limits = Limits(), min_rows: int = SLOTS) -> DataFrame:
    """One set of weights per series from the clean error over all rows given."""
    clean = is_clean(y, limits)
    n = F.count_if(clean)
    maes = df.groupBy("series_id").agg(
        n.alias("__n"), *[F.avg(F.when(clean, F.abs(F.col(y) - F.col(m)))).alias(f"__e_{m}") for m in models]
    )
    inv = maes.select("series_id", "__n", *[inverse_error(f"__e_{m}").alias(f"__i_{m}") for m in models])
    total = reduce(lambda a, b: a + b, [F.col(f"__i_{m}") for m in models])
    enough = F.col("__n") >= min_rows
    return inv.select("series_id", *[
        F.when(enough, F.col(f"__i_{m}") / total).otherwise(F.lit(1.0 / len(models))).alias(f"w_{m}") for m in models
    ])


def daily_residual(df: DataFrame, y: str = "y", base: str = "base", limits: Limits = Limits()) -> DataFrame:
    """Median clean residual per series and day; NULL on a day without clean rows."""
    r = F.when(is_clean(y, limits), F.col(y) - F.col(base))
    return df.groupBy("series_id", "date").agg(F.median(r).alias("residual"))


def trailing_bias(days: DataFrame, bias_days: int, reveal_lag_days: int = 2, min_days: int = 3, out: str = "bias") -> DataFrame:
    """Median of the daily residuals over the last ``bias_days`` day rows known at the origin."""
    w = across_days().rowsBetween(-(bias_days + reveal_lag_days - 1), -reveal_lag_days)
    enough = F.count("residual").over(w) >= min_days
    return days.withColumn(out, F.when(enough, F.expr("percentile(residual, 0.5)").over(w)))


def day_values(df: DataFrame, y: str = "y") -> DataFrame:
    """The actuals of each day as one array of at most 48 numbers."""
    return df.groupBy("series_id", "date").agg(F.collect_list(y).alias("day_values"))


def trailing_cap(
    days: DataFrame, cap_days: int, quantile: float = 0.98, reveal_lag_days: int = 1, min_rows: int = SLOTS, out: str = "cap"
) -> DataFrame:
    """High quantile of the actuals of the last ``cap_days`` calendar days known at the origin."""
    pooled = F.array_sort(F.flatten(F.collect_list("day_values").over(calendar_days(cap_days, reveal_lag_days))))
    staged = days.withColumn("__v", pooled)
    return staged.withColumn(out, F.when(F.size("__v") >= min_rows, sorted_quantile(F.col("__v"), quantile))).drop("__v")


def merge_revealed(history: DataFrame, revealed: DataFrame, keys=("series_id", "ts")) -> DataFrame:
    """History and newly revealed rows in one table; a revealed row replaces a historical one."""
    both = history.withColumn("__p", F.lit(0)).unionByName(revealed.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return dedup_last(both, list(keys), ["__p"]).drop("__p")


def walk_forward_adjust(
    df: DataFrame,
    history: DataFrame | None = None,
    y: str = "y",
    base: str = "base",
    bias_days: int = 14,
    cap_days: int = 28,
    cap_ratio: float | None = 0.95,
    cap_quantile: float = 0.98,
    reveal_lag_days: int = 2,
    min_bias_days: int = 3,
    min_cap_rows: int = SLOTS,
    limits: Limits = Limits(),
    out: str = "adjusted",
) -> DataFrame:
    """Bias shift, then snap to the trailing cap, then clip; each day from earlier days only.

    ``history`` adds actuals from before ``df`` to the cap. Equal to ``trailing_bias`` and
    ``trailing_cap`` on day rows, but taken over the panel rows: windows inside a series,
    no join.
    """
    rows, capped = df.withColumn("__target", F.lit(True)), bool(cap_days and cap_ratio is not None)
    if capped and history is not None:
        older = history.select("series_id", "ts", "date", y).withColumn("__target", F.lit(False))
        both = rows.unionByName(older, allowMissingColumns=True)
        next_ts = F.lead("ts").over(Window.partitionBy("series_id").orderBy("ts", "__target"))
        rows = both.withColumn("__next", next_ts).where(F.col("__next").isNull() | (F.col("__next") != F.col("ts")))
    shifted = F.col(base)
    if bias_days:
        day = Window.partitionBy("series_id", "date")
        residual = F.when(is_clean(y, limits) & F.col("__target"), F.col(y) - F.col(base))
        rows = rows.withColumn("__resid", residual).withColumns({
            "__r": F.expr("percentile(__resid, 0.5)").over(day),
            "__i": F.row_number().over(day.orderBy("ts")),
            "__d": F.dense_rank().over(across_days()),
        })
        w = Window.partitionBy("series_id").orderBy("__d").rangeBetween(-(bias_days + reveal_lag_days - 1), -reveal_lag_days)
        once = rows.withColumn("__r", F.when(F.col("__i") == 1, F.col("__r")))
        enough = F.count("__r").over(w) >= min_bias_days
        rows = once.withColumn("__bias", F.when(enough, F.expr("percentile(__r, 0.5)").over(w)))
        shifted = shifted + F.coalesce(F.col("__bias"), F.lit(0.0))
    if capped:
        w = calendar_days(cap_days, reveal_lag_days)
        enough = F.count(y).over(w) >= min_cap_rows
        rows = rows.withColumn("__cap", F.when(enough, F.percentile(y, F.lit(cap_quantile)).over(w)))
        shifted = cap_snap(shifted, F.col("__cap"), cap_ratio)
    return rows.where("__target").withColumn(out, publishable(shifted, limits)).select(*df.columns, out)


def require_whole_day(target: DataFrame, slots: int = SLOTS) -> None:
    """Raise unless every series has exactly ``slots`` rows on exactly one date."""
    shape = target.groupBy("series_id").agg(F.count("*").alias("n"), F.countDistinct("date").alias("d"))
    bad = shape.where((F.col("n") != slots) | (F.col("d") != 1)).limit(1).collect()
    if bad or not target.take(1):
        raise ValueError(f"day-ahead adjustment needs exactly {slots} slots of one date per series")


def single_day_state(
    target: DataFrame,
    history: DataFrame,
    y: str = "y",
    base: str = "base",
    bias_days: int = 14,
    cap_days: int = 28,
    cap_quantile: float = 0.98,
    min_bias_days: int = 3,
    min_cap_rows: int = SLOTS,
    limits: Limits = Limits(),
) -> DataFrame:
    """Per series: median clean residual and high quantile over the last days before the target day.

    Only rows that carry both an actual and a base forecast count. The date filter leaves
    at most ``max(bias_days, cap_days)`` days per series before the aggregation.
    """
    day = target.groupBy("series_id").agg(F.max("date").alias("target_date"))
    h = history.dropna(subset=[y, base]).join(day, "series_id")
    h = h.where(
        (F.col("date") < F.col("target_date"))
        & (F.col("date") >= F.date_sub("target_date", max(bias_days, cap_days, 1)))
    )
    in_bias = (F.col("date") >= F.date_sub("target_date", bias_days)) & is_clean(y, limits)
    in_cap = F.col("date") >= F.date_sub("target_date", cap_days)
    enough = F.countDistinct(F.when(in_bias, F.col("date"))) >= min_bias_days
    cap = F.percentile(F.when(in_cap, F.col(y)), F.lit(cap_quantile))
    return h.groupBy("series_id").agg(
        F.when(enough, F.median(F.when(in_bias, F.col(y) - F.col(base)))).alias("bias"),
        F.when(F.count_if(in_cap) >= min_cap_rows, cap).alias("cap"),
    )


def single_day_adjust(
    target: DataFrame,
    history: DataFrame,
    base: str = "base",
    bias_days: int = 14,
    cap_days: int = 28,
    cap_ratio: float | None = 0.95,
    slots: int = SLOTS,
    limits: Limits = Limits(),
    out: str = "adjusted",
    check: bool = True,
    **kw,
) -> DataFrame:
    """The walk-forward rules for one target day per series."""
    if check:
        require_whole_day(target, slots)
    state = single_day_state(target, history, base=base, bias_days=bias_days, cap_days=cap_days, limits=limits, **kw)
    j = target.join(state, "series_id", "left")
    shifted = F.col(base) + F.coalesce(F.col("bias"), F.lit(0.0)) if bias_days else F.col(base)
    snapped = cap_snap(shifted, F.col("cap"), cap_ratio) if cap_days and cap_ratio is not None else shifted
    return j.withColumn(out, publishable(snapped, limits)).drop("bias", "cap")
