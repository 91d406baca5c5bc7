"""Day rows of 48 slots: feature vectors, targets and their scaling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.limits import SLOTS


def slot_array(entries: str, field: str) -> Column:
    """Values of ``field`` by slot from one entry per slot, sorted; a slot without a row is NULL.

    A day with all its slots is read off directly; only an incomplete one is looked up.
    """
    whole = f"transform({entries}, __e -> double(__e.`{field}`))"
    lookup = (
        f"transform(sequence(0, {SLOTS - 1}), "
        f"__s -> double(get(filter({entries}, __e -> __e.cycle = __s), 0).`{field}`))"
    )
    return F.expr(f"if(size({entries}) = {SLOTS}, {whole}, {lookup})")


def last_per_slot(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per series, day and slot: of repeated ones the last by ``ts``, where there is one, and by values."""
    order = [c for c in ("ts",) if c in df.columns] + list(dict.fromkeys(columns))
    kept = F.max_by(F.struct(*dict.fromkeys(columns)), F.struct(*order)).alias("__row")
    return df.where(F.col("cycle").between(0, SLOTS - 1)).groupBy("series_id", "date", "cycle").agg(kept).select("series_id", "date", "cycle", "__row.*")


def fill_slots(array: str) -> Column:
    """Missing slots take the last value of the day, else the next one, else 0."""
    known = "filter({}, __v -> __v is not null)"
    before, after = (known.format(f"slice({array}, {part})") for part in ("1, __i + 1", f"__i + 1, {SLOTS}"))
    return F.expr(f"""transform({array}, (__x, __i) -> coalesce(
        __x, get(reverse({before}), 0), get({after}, 0), double(0)))""")


def day_profiles(df: DataFrame, profile: list[str], scalar: list[str] = [], fill: bool = True) -> DataFrame:
    """One row per series and day: a 48-slot array per profile column, the first value of each scalar one."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("cycle"))).cast("double").alias(c) for c in scalar]
    df = last_per_slot(df, [c for c in dict.fromkeys([*profile, *scalar]) if c not in ("cycle", "date", "series_id")])
    days = df.groupBy("series_id", "date").agg(
        F.array_sort(F.collect_list(F.struct("cycle", *profile))).alias("__rows"), *firsts
    )
    out = days.withColumns({c: slot_array("__rows", c) for c in profile}).drop("__rows")
    if fill:
        out = out.withColumns({c: fill_slots(f"`{c}`") for c in profile})
        if scalar:
            out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in scalar})
    return out.select("series_id", "date", *profile, *scalar)


def daily_matrix(df: DataFrame, profile: list[str], scalar: list[str] = []) -> DataFrame:
    """``features``: every profile slot by slot, then the scalars, as one vector without gaps."""
    days = day_profiles(df, profile, scalar)
    parts = [F.col(c) for c in profile] + ([F.array(*scalar)] if scalar else [])
    return days.select("series_id", "date", F.concat(*parts).alias("features"))


def daily_targets(df: DataFrame, y: str = "y") -> DataFrame:
    """``targets``: the 48 values of each day on which all of them are present."""
    days = day_profiles(df, [y], fill=False)
    return days.where(F.size(F.filter(y, lambda v: v.isNotNull())) == SLOTS).select(
        "series_id", "date", F.col(y).alias("targets")
    )


def slot_columns(days: DataFrame, array: str) -> DataFrame:
    """A 48-slot array as columns ``c00`` to ``c47``."""
    return days.select("series_id", "date", *[F.get(array, F.lit(i)).alias(f"c{i:02d}") for i in range(SLOTS)])


def explode_daily(days: DataFrame, array: str = "targets", out: str = "pred") -> DataFrame:
    """Day arrays back to one row per slot, ready to join on (series_id, date, cycle)."""
    return days.select("series_id", "date", F.posexplode(array).alias("cycle", out))


def rows_from_daily(rows: DataFrame, days: DataFrame, array: str = "targets", out: str = "pred") -> DataFrame:
    """Look every panel row up in a daily forecast."""
    return rows.join(explode_daily(days, array, out), ["series_id", "date", "cycle"], "left")


def training_days(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Days that have both a feature vector and complete targets."""
    return features.join(targets, ["series_id", "date"])


def robust_params(days: DataFrame, array: str, low: float = 0.1, high: float = 0.9, floor: float = 0.0) -> DataFrame:
    """Per series and position: median and ``high - low`` quantile range over its days.

    A range at or below ``floor`` becomes 1. Groups are one number per day.
    """
    long = days.select("series_id", F.posexplode(array).alias("pos", "v"))
    q = long.groupBy("series_id", "pos").agg(F.percentile("v", F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    return q.select(
        "series_id", "pos", F.col("q")[1].alias("center"), F.when(spread > floor, spread).otherwise(1.0).alias("scale")
    )


def scale_days(days: DataFrame, params: DataFrame, array: str = "features") -> DataFrame:
    """Centre and scale every position of the vectors."""
    packed = params.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "center", "scale"))).alias("__p"))
    scaled = F.zip_with(array, "__p", lambda x, p: (x - p["center"]) / p["scale"])
    return days.join(packed, "series_id").withColumn(array, scaled).drop("__p")
