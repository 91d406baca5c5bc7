"""Forecast errors: overall, clean band and low regime, from one conditional aggregation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col
from slotcast.functions.regime import is_clean, is_low, publishable
from slotcast.limits import Limits

# fixed values: the accuracy target
TARGET_MAE = 150.0
TARGET_WMAPE = 10.0


def _ratio(num: Column, den: Column, otherwise=None) -> Column:
    return F.when(den > 0, num / den).otherwise(otherwise)


def metric_columns(actual="y", prediction="pred", weight: str | None = None, limits: Limits = Limits()) -> list[Column]:
    """Aggregates for ``groupBy(...).agg``; with ``weight`` also precision and recall of the gate itself."""
    y, p = as_col(actual), as_col(prediction)
    err, clean, low = F.abs(y - p), is_clean(y, limits), is_low(y, limits)

    def total(cond: Column, v: Column) -> Column:
        return F.sum(F.when(cond, v).otherwise(0.0))

    n = F.count(F.lit(1))
    n_clean, n_low = F.count_if(clean), F.count_if(low)
    clean_abs = total(clean, F.abs(y))
    out = [
        n.alias("samples"),
        F.avg(err).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (100.0 * _ratio(F.sum(err), F.sum(F.abs(y)))).alias("wmape"),
        n_clean.alias("clean_samples"),
        (n_clean / n).alias("valid_share"),
        _ratio(total(clean, err), n_clean).alias("clean_mae"),
        F.sqrt(_ratio(total(clean, err * err), n_clean)).alias("clean_rmse"),
        (100.0 * _ratio(total(clean, err / F.when(y != 0, F.abs(y))), n_clean)).alias("clean_mape"),
        (100.0 * _ratio(total(clean, err), clean_abs)).alias("clean_wmape"),
        n_low.alias("low_samples"),
        _ratio(total(low, err), n_low).alias("low_mae"),
    ]
    called = [("low", is_low(p, limits))]
    if weight:
        called.append(("gate", as_col(weight) >= 0.5))
    for name, flag in called:
        hit = F.count_if(low & flag)
        out.append(_ratio(hit, F.count_if(flag), 0.0).alias(f"{name}_precision"))
        out.append(_ratio(hit, n_low, 0.0).alias(f"{name}_recall"))
    return out


def scored(df: DataFrame, actual="y", prediction="pred") -> DataFrame:
    """Rows with both an actual and a forecast."""
    return df.dropna(subset=[actual, prediction])


def metrics(
    df: DataFrame, by=(), actual: str = "y", prediction: str = "pred", weight: str | None = None, limits: Limits = Limits()
) -> DataFrame:
    """One row of metrics per group of ``by``."""
    return scored(df, actual, prediction).groupBy(*by).agg(*metric_columns(actual, prediction, weight, limits))


def with_target_met(m: DataFrame, mae: float = TARGET_MAE, wmape: float = TARGET_WMAPE) -> DataFrame:
    """Whether both accuracy targets hold."""
    return m.withColumn("target_met", (F.col("clean_mae") < mae) & (F.col("clean_wmape") < wmape))


def report(
    df: DataFrame, actual: str = "y", prediction: str = "pred", weight: str | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Per series: overall, by slot and by month at once, as grouping sets over one scan.

    ``level`` is ``all``, ``cycle`` or ``month``.
    """
    dated = scored(df, actual, prediction).withColumns({"year": F.year("date"), "month": F.month("date")})
    sets = [["series_id"], ["series_id", "cycle"], ["series_id", "year", "month"]]
    level = F.when(F.grouping("cycle") == 0, "cycle").when(F.grouping("month") == 0, "month").otherwise("all")
    return dated.groupingSets(sets, "series_id", "cycle", "year", "month").agg(
        level.alias("level"), *metric_columns(actual, prediction, weight, limits)
    )


def baseline(df: DataFrame, lag: str, by=(), actual: str = "y", limits: Limits = Limits()) -> DataFrame:
    """Clean error of the seasonal-naive forecast: a lag column, clipped like any forecast."""
    m = metrics(df.withColumn("__base", publishable(lag, limits)), by, actual, "__base", limits=limits)
    return m.select(*by, "clean_samples", F.col("clean_mae").alias("baseline_mae"), F.col("clean_wmape").alias("baseline_wmape"))
