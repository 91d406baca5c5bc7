"""One row per series and day: morning, full-day and trailing statistics.

The wide panel is reduced to days once. Everything that looks back over days then
runs on that table, 1/48 of the rows, and is joined to the panel once.

A trailing statistic taken at the cutoff slot of day D covers the morning of D and
the afternoons before D. So each day is kept as two halves, and a window of n days
ending at the cutoff is n mornings up to D and n afternoons up to D - 1.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.clock import before_cutoff
from slotcast.functions.numeric import sorted_quantile
from slotcast.limits import CUTOFF_SLOT, Limits
from slotcast.operators.frames import across_days


def _over(cond: Column, value) -> Column:
    return F.when(cond, F.col(value) if isinstance(value, str) else value)


def half_days(
    df: DataFrame,
    y: str = "y",
    load: str | None = None,
    regional: tuple[str, str] | None = None,
    limits: Limits = Limits(),
    cutoff: int = CUTOFF_SLOT,
    values: bool = True,
) -> DataFrame:
    """Aggregates of each day's morning (slots up to the cutoff) and afternoon."""
    am, low = before_cutoff(cutoff), F.coalesce((F.col(y) <= limits.low).cast("double"), F.lit(0.0))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(am & F.col(c).isNotNull(), F.col("cycle")))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(am & F.col(c).isNotNull(), F.col("cycle")))

    def shape(c: str, name: str) -> list[Column]:
        m = _over(am, c)
        return [
            F.avg(m).alias(f"m_{name}_mean"), F.stddev_samp(m).alias(f"m_{name}_std"),
            F.max(m).alias(f"m_{name}_max"), F.min(m).alias(f"m_{name}_min"),
            first(c).alias(f"m_{name}_first"), last(c).alias(f"m_{name}_last"),
        ]

    aggs = [
        *shape(y, "y"),
        F.median(_over(am, y)).alias("m_y_median"),
        F.avg(_over(am, low)).alias("m_low_share"),
        F.avg(y).alias("d_y_mean"), F.max(y).alias("d_y_max"), F.min(y).alias("d_y_min"),
        F.avg(low).alias("d_low_share"),
    ]
    if load:
        aggs += shape(load, "load")
    if regional:
        for side, c in zip(("north", "south"), regional):
            aggs += [F.avg(_over(am, c)).alias(f"m_{side}_mean"), last(c).alias(f"m_{side}_last")]
    for half, cond in (("am", am), ("pm", ~am)):
        v = _over(cond, y)
        aggs += [
            F.count(v).alias(f"{half}_n"), F.avg(v).alias(f"{half}_mean"), F.var_pop(v).alias(f"{half}_var"),
            F.count(F.when(cond, 1)).alias(f"{half}_rows"), F.sum(_over(cond, low)).alias(f"{half}_low"),
        ]
        if values:
            aggs.append(F.collect_list(v).alias(f"{half}_values"))
    return df.groupBy("series_id", "date").agg(*aggs)


def morning_features(days: DataFrame, y: str = "y", load: str = "load", shift: int = 1) -> dict[str, Column]:
    """Morning of the origin day (``shift`` = 1: the day before the target), levels against the day before."""
    w = across_days()

    def at(name: str, k: int = shift) -> Column:
        return F.lag(name, k).over(w)

    out = {}
    for tag, label in (("y", y), ("load", load)):
        if f"m_{tag}_mean" not in days.columns:
            continue
        for k in ("mean", "std", "max", "min", "first", "last"):
            out[f"morning_{label}_{k}"] = at(f"m_{tag}_{k}")
        out[f"morning_{label}_range"] = at(f"m_{tag}_max") - at(f"m_{tag}_min")
        out[f"morning_{label}_trend"] = at(f"m_{tag}_last") - at(f"m_{tag}_first")
        out[f"morning_{label}_level_change"] = at(f"m_{tag}_mean") - at(f"m_{tag}_mean", shift + 1)
    out[f"morning_{y}_median"] = at("m_y_median")
    out["morning_low_share"] = at("m_low_share")
    if "m_north_mean" in days.columns:
        for k in ("mean", "last"):
            out[f"morning_{y}_north_{k}"], out[f"morning_{y}_south_{k}"] = at(f"m_north_{k}"), at(f"m_south_{k}")
            out[f"morning_spread_ns_{k}"] = at(f"m_north_{k}") - at(f"m_south_{k}")
    return out


def full_day_features(y: str = "y", shift: int = 2) -> dict[str, Column]:
    """The newest complete day at the origin: two days before the target."""
    w = across_days()
    return {
        **{f"prev_full_{y}_{k}": F.lag(f"d_y_{k}", shift).over(w) for k in ("mean", "max", "min")},
        "prev_full_low_share": F.lag("d_low_share", shift).over(w),
    }


def _halves(name: str, n: int, shift: int, agg) -> tuple[Column, Column]:
    """``agg`` over the n mornings and the n afternoons before the cutoff, ``shift`` days ahead of the target."""
    am = agg(f"am_{name}").over(across_days().rowsBetween(-(shift + n - 1), -shift))
    pm = agg(f"pm_{name}").over(across_days().rowsBetween(-(shift + n), -(shift + 1)))
    return am, pm


def _total(name: str, n: int, shift: int) -> Column:
    am, pm = _halves(name, n, shift, F.sum)
    return F.coalesce(am, F.lit(0.0)) + F.coalesce(pm, F.lit(0.0))


def _parts(n: int, shift: int) -> Column:
    """The (n, mean, var) of each half day in the window, as one array."""
    def pack(half: str) -> Column:
        return F.struct(
            F.col(f"{half}_n").alias("n"), F.col(f"{half}_mean").alias("mean"), F.col(f"{half}_var").alias("var")
        )

    am = F.collect_list(pack("am")).over(across_days().rowsBetween(-(shift + n - 1), -shift))
    pm = F.collect_list(pack("pm")).over(across_days().rowsBetween(-(shift + n), -(shift + 1)))
    return F.filter(F.concat(am, pm), lambda p: p["n"] > 0)


def trailing_moments(df: DataFrame, windows: dict[str, tuple[int, int]], shift: int = 1) -> DataFrame:
    """``<name>_mean`` and ``<name>_std`` per (days, least count), over rows that end at the cutoff.

    Half-day moments are merged in two passes, the mean first: no difference of large
    sums, so a constant stretch has a spread of exactly 0.
    """
    def fold(name: str, term: str):
        return F.expr(f"aggregate(`__p_{name}`, double(0), (__t, __p) -> __t + {term})")

    parts = df.withColumns({f"__p_{k}": _parts(n, shift) for k, (n, _) in windows.items()})
    counted = parts.withColumns({f"__n_{k}": fold(k, "__p.n") for k in windows})
    total = {k: fold(k, "__p.n * __p.mean") / F.when(F.col(f"__n_{k}") > 0, F.col(f"__n_{k}")) for k in windows}
    means = counted.withColumns({f"{k}_mean": F.when(F.col(f"__n_{k}") >= least, total[k]) for k, (_, least) in windows.items()})
    gap = "(__p.mean - `{0}_mean`)"
    out = means.withColumns({
        f"{k}_std": F.sqrt(
            fold(k, f"__p.n * (__p.var + {gap.format(k)} * {gap.format(k)})") / F.when(F.col(f"__n_{k}") > 1, F.col(f"__n_{k}") - 1)
        ) for k in windows
    })
    return out.drop(*[f"__{t}_{k}" for t in "pn" for k in windows])


def trailing_values(n: int, shift: int = 1) -> Column:
    """Ascending values of n days of rows ending at the cutoff: at most n * 48 numbers."""
    am, pm = _halves("values", n, shift, F.collect_list)
    return F.array_sort(F.flatten(F.concat(am, pm)))


def trailing_low_rate(n: int, min_rows: int, shift: int = 1) -> Column:
    """Share of rows at or below the low limit; a missing value counts as not low."""
    rows = _total("rows", n, shift)
    return F.when(rows >= min_rows, _total("low", n, shift) / rows)


def snapshot_features(days: DataFrame, y: str = "y", quantile_days: int = 28, shift: int = 1) -> DataFrame:
    """Trailing statistics at the origin's cutoff, one row per target day, next to ``days``' columns."""
    moments = trailing_moments(days, {"__1d": (1, 24), "__7d": (7, 168)}, shift)
    staged = moments.withColumns({
        f"{y}_rolling_std_1d": F.col("__1d_std"), f"{y}_rolling_std_7d": F.col("__7d_std"), f"{y}_rolling_mean_7d": F.col("__7d_mean"),
        "low_rate_7d": trailing_low_rate(7, 336 // 2, shift), "low_rate_30d": trailing_low_rate(30, 1440 // 2, shift),
        "__sorted": trailing_values(quantile_days, shift),
    }).drop("__1d_mean", "__1d_std", "__7d_mean", "__7d_std")
    enough = F.size("__sorted") >= quantile_days * 12
    return staged.withColumns({
        f"{y}_rolling_{name}_{quantile_days}d": F.when(enough, sorted_quantile(F.col("__sorted"), q))
        for name, q in (("median", 0.5), ("q90", 0.9), ("q98", 0.98))
    }).drop("__sorted")


def day_features(
    df: DataFrame,
    y: str = "y",
    load: str | None = None,
    regional: tuple[str, str] | None = None,
    limits: Limits = Limits(),
    cutoff: int = CUTOFF_SLOT,
    quantile_days: int = 28,
    y_label: str | None = None,
    load_label: str | None = None,
) -> DataFrame:
    """All day-level features, keyed by the target day they are for."""
    y_label, load_label = y_label or y, load_label or load
    days = half_days(df, y, load, regional, limits, cutoff)
    snap = snapshot_features(days, y_label, quantile_days)
    made = {**morning_features(days, y_label, load_label), **full_day_features(y_label)}
    keep = [c for c in snap.columns if c not in days.columns]
    return snap.select("series_id", "date", *keep, *[c.alias(n) for n, c in made.items()])


def attach_day_features(df: DataFrame, feats: DataFrame) -> DataFrame:
    """Every slot of a target day gets that day's features."""
    return df.join(feats, ["series_id", "date"], "left")


def shift_days(days: DataFrame, offset: int) -> DataFrame:
    """Relabel day rows with the target day they serve, ``offset`` days later."""
    return days.withColumn("date", F.date_add("date", offset))
