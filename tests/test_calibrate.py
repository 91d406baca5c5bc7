import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions.clock import with_clock
from slotcast.limits import Limits
from slotcast.operators import calibrate, metrics


def stretch(spark, start, slots, actual, base, series="a"):
    df = spark.range(slots).select(
        F.lit(series).alias("series_id"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))).alias("ts"),
        actual.cast("double").alias("y"), base.cast("double").alias("base"),
    )
    return with_clock(df)


def test_metrics_report_the_low_regime(spark):
    df = spark.createDataFrame([(0.0, 100.0), (1000.0, 900.0), (2000.0, 2000.0)], "y double, pred double")
    m = metrics.metrics(df).first()
    assert (m.samples, m.low_samples, m.low_precision, m.low_recall, m.low_mae) == (3, 1, 1.0, 1.0, 100.0)
    assert m.mae == pytest.approx(200 / 3) and m.clean_mae == 50.0
    assert m.clean_wmape == pytest.approx(100 * 100 / 3000) and m.clean_mape == pytest.approx(5.0)


@pytest.mark.parametrize("reveal", [1, 2])
def test_later_actuals_do_not_change_earlier_forecasts(spark, reveal):
    late = F.when(F.col("id") >= 48 * 7, 1700).otherwise(1100)
    kw = {"bias_days": 7, "cap_days": 0, "cap_ratio": None, "reveal_lag_days": reveal}
    one = calibrate.walk_forward_adjust(stretch(spark, "2025-01-01", 480, F.lit(1100), F.lit(1000)), **kw)
    two = calibrate.walk_forward_adjust(stretch(spark, "2025-01-01", 480, late, F.lit(1000)), **kw)
    a, b = (x.orderBy("ts").toPandas()["adjusted"].to_numpy() for x in (one, two))
    np.testing.assert_array_equal(a[: 48 * 8], b[: 48 * 8])
    assert a[0] == 1000 and a[48 * (2 + reveal)] == 1100
    # three days at 1700 make the median of the last seven move only once they are the majority
    assert b[-1] == 1100


def test_cap_uses_completed_history(spark):
    history = stretch(spark, "2025-01-01", 48 * 28, F.lit(1700), F.lit(1650))
    target = stretch(spark, "2025-01-29", 48, F.lit(0), F.lit(1650)).drop("y")
    out = calibrate.single_day_adjust(target, history, bias_days=0, cap_days=28, cap_ratio=0.95)
    assert {r.adjusted for r in out.collect()} == {1700.0}


def test_single_day_needs_48_slots(spark):
    history = stretch(spark, "2025-01-01", 96, F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        calibrate.single_day_adjust(stretch(spark, "2025-01-29", 47, F.lit(0), F.lit(1)), history)
    with pytest.raises(ValueError):
        calibrate.single_day_adjust(stretch(spark, "2025-01-29 07:30:00", 48, F.lit(0), F.lit(1)), history)


def noisy(spark, days=12):
    rng = np.random.default_rng(5)
    ts = pd.date_range("2025-05-01", periods=days * 48, freq="30min")
    pdf = pd.DataFrame({"series_id": "a", "ts": ts.astype(str), "y": rng.uniform(300, 2600, len(ts))})
    for i, m in enumerate(("m1", "m2", "m3")):
        pdf[m] = pdf["y"] + rng.normal(20 * i, 60 * (i + 1), len(ts))
    df = with_clock(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    return pdf.assign(ts=ts).set_index("ts"), df


def test_trailing_blend_against_a_daily_loop(spark):
    pdf, df = noisy(spark)
    models = ["m1", "m2", "m3"]
    out = calibrate.trailing_blend(df, models, lookback_days=4, reveal_lag_days=1).toPandas().set_index("ts").sort_index()
    dates = pdf.index.normalize()
    for day in dates.unique():
        past = (dates < day) & (dates >= day - pd.Timedelta(days=4)) & (pdf["y"] > 500) & (pdf["y"] < 2500)
        w = np.full(3, 1 / 3)
        if past.sum() >= 48:
            e = np.array([np.abs(pdf["y"] - pdf[m])[past].mean() for m in models])
            w = (1 / np.maximum(e, 25)) / (1 / np.maximum(e, 25)).sum()
        np.testing.assert_allclose(out.loc[dates == day, "blend"], pdf.loc[dates == day, models].to_numpy() @ w)


def test_walk_forward_against_rolling_windows(spark):
    pdf, df = noisy(spark)
    hist_ts = pd.date_range("2025-04-20", periods=11 * 48, freq="30min")
    older = pd.DataFrame({"series_id": "a", "ts": hist_ts.astype(str), "y": np.linspace(900, 1900, len(hist_ts))})
    history = with_clock(spark.createDataFrame(older).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    wide = Limits(ceiling=1e9, floor=-1e9)
    out = calibrate.walk_forward_adjust(
        df.withColumn("base", F.col("m2")), history, bias_days=5, cap_days=7, cap_ratio=0.9, reveal_lag_days=1, limits=wide
    ).toPandas().set_index("ts").sort_index()["adjusted"]
    dates = pdf.index.normalize()
    resid = (pdf["y"] - pdf["m2"]).where((pdf["y"] > 500) & (pdf["y"] < 2500))
    bias = resid.groupby(dates).median().rolling(5, min_periods=3).median().shift(1)
    known = pd.concat([pd.Series(older["y"].to_numpy(), hist_ts), pdf["y"]]).sort_index()
    cap = known.rolling("7D", min_periods=48, closed="left").quantile(0.98).reindex(dates.unique())
    want = pdf["m2"] + pd.Series(dates, pdf.index).map(bias).fillna(0)
    row_cap = pd.Series(dates, pdf.index).map(cap)
    want = want.mask(want >= 0.9 * row_cap, row_cap)
    np.testing.assert_allclose(out, want)


def test_merge_revealed_prefers_the_new_row(spark):
    a = spark.createDataFrame([("s", dt.datetime(2025, 1, 1), 1.0), ("s", dt.datetime(2025, 1, 2), 2.0)], "series_id string, ts timestamp_ntz, y double")
    b = spark.createDataFrame([("s", dt.datetime(2025, 1, 2), 9.0)], "series_id string, ts timestamp_ntz, y double")
    assert sorted(r.y for r in calibrate.merge_revealed(a, b).collect()) == [1.0, 9.0]
