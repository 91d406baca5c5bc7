import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.operators import panel
from slotcast.sources import readers


def holed(seed=3, days=23, start="2024-03-01 09:30:00", lost=0.4):
    """Two series with a partial first day, random holes and a missing stretch of two days."""
    rng = np.random.default_rng(seed)
    out = []
    for s in ("a", "b"):
        ts = pd.date_range(start, periods=days * 48 - 11, freq="30min")
        y = rng.normal(50, 9, len(ts)).round(2)
        keep = rng.random(len(ts)) > lost
        keep[[0, -1]] = True
        keep[100:200] = False
        out.append(pd.DataFrame({"series_id": s, "ts": ts[keep], "y": y[keep]}))
    return pd.concat(out)


def expected(raw):
    out = []
    for s, g in raw.groupby("series_id"):
        x = g.set_index("ts")["y"]
        x = x.reindex(pd.date_range(x.index.min(), x.index.max(), freq="30min"))
        x = x.fillna(x.shift(336)).ffill()
        out.append(pd.DataFrame({"series_id": s, "ts": x.index, "y": x.values}))
    return pd.concat(out).sort_values(["series_id", "ts"]).reset_index(drop=True)


def as_frame(df):
    return df.select("series_id", "ts", "y").toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def raw(spark):
    pdf = holed()
    return pdf, spark.createDataFrame(pdf.assign(ts=pdf["ts"].astype(str))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def same(a, b):
    pd.testing.assert_frame_equal(a.astype({"ts": "datetime64[us]"}), b.astype({"ts": "datetime64[us]"}))


def test_build_panel_equals_shift_and_ffill(raw):
    pdf, df = raw
    same(as_frame(panel.build_panel(df, "series_id", "ts", y=F.avg("y"))), expected(pdf))


@pytest.mark.parametrize("whole_days", [True, False])
def test_grid_attach_impute_equal_shift_and_ffill(raw, whole_days):
    pdf, df = raw
    grid = panel.make_grid(df, whole_days=whole_days)
    out = panel.impute(panel.attach(grid, df), ["y"], whole_days=whole_days)
    if whole_days:
        out = out.where("in_span")
    same(as_frame(out), expected(pdf))
    assert out.where("not y_observed").count() == len(expected(pdf)) - len(pdf)


def test_nan_and_infinity_count_as_missing(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0), 1.0), ("a", dt.datetime(2024, 1, 1, 0, 30), float("nan")),
            ("a", dt.datetime(2024, 1, 1, 1, 0), float("inf")), ("a", dt.datetime(2024, 1, 1, 1, 30), 4.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    for out in (panel.impute(df.transform(panel.with_clock), ["y"]), panel.build_panel(df, "series_id", "ts", y=F.max("y"))):
        assert [r.y for r in out.orderBy("ts").collect()] == [1.0, 1.0, 1.0, 4.0]


def test_dedup(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), ("k", 1, "y"), ("m", 5, "z")], "k string, o int, v string")
    first = {r.k: r.v for r in panel.dedup_first(df, ["k"], ["o", "v"]).collect()}
    last = {r.k: (r.o, r.v) for r in panel.dedup_last(df, ["k"], ["o"]).collect()}
    assert first == {"k": "x", "m": "z"} and last == {"k": (2, None), "m": (5, "z")}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """A small input directory in the expected layout, with repeats, gaps and several hydro files."""
    d = tmp_path_factory.mktemp("raw")
    for sub in ("market", "hydro", "exogenous"):
        (d / sub).mkdir()
    ts = pd.date_range("2025-03-01", periods=48 * 12, freq="30min")
    n = np.arange(len(ts), dtype=float)
    price = pd.DataFrame({"datetime": ts, **{c: n + i for i, c in enumerate(readers.PRICE)}}).drop(index=[5, 400, 401])
    pd.concat([price, price.iloc[[3]]]).to_csv(d / "market/smp_prices_nsmo.csv", index=False)
    pd.DataFrame({"datetime": ts, **{c: n * 2 + i for i, c in enumerate(readers.LOAD)}}).iloc[10:].to_csv(
        d / "market/load_data_nsmo.csv", index=False)
    hours = ts[::2]
    for k in (1, 2):
        plants = pd.concat([pd.DataFrame({
            "datetime": hours, **{c: float(k * p) for c in readers.HYDRO_FLOWS}, "water_level_m": 10.0 * k + p}) for p in (1, 2)])
        plants.to_csv(d / f"hydro/hydro_hourly_{k}.csv", index=False)
    days = pd.date_range("2025-03-01", periods=12).strftime("%Y-%m-%d")
    rows = [(x, name, 1000.0 * (i + 1), 1.0, 2.0) for x in days for i, name in enumerate(
        ["Toàn QUỐC", "Thủy điện", "Điện mặt trời trang trại", "Điện gió", None])]
    pd.DataFrame(rows, columns=["date", "resource_type", *readers.CAPACITY]).to_csv(d / "market/dispatch_capacity_nsmo.csv", index=False)
    pd.DataFrame({"datetime": ts, "date": ts.strftime("%Y-%m-%d"), "cycle_id": n % 48, "source": "x", "timezone": "y",
                  "temperature_hanoi": n / 10, "wind_speed_hcmc": n % 7, "note": "text"}).to_csv(
        d / "exogenous/weather_3_regions_30min_open_meteo.csv", index=False)
    pd.DataFrame({"date": days[::3], "brent_price": [70.0, 71.0, 72.0, 73.0]}).to_csv(d / "exogenous/fuel_macro_yfinance_clean.csv", index=False)
    pd.DataFrame({"date": days, "is_holiday": [0] * 11 + [1], "season": 2}).to_csv(d / "exogenous/calendar_vietnam.csv", index=False)
    return d


def test_load_sources(spark, root):
    df = readers.load_sources(spark, str(root))
    out = df.toPandas().set_index("ts").sort_index()
    assert len(out) == 48 * 12
    assert "note" not in out and "timezone" not in out and "coal_proxy_price" not in out
    t = lambda s: pd.Timestamp(s)
    assert out.loc[t("2025-03-01 02:30"), "smp_system_price"] == 4.0  # forward fill
    assert out.loc[t("2025-03-09 08:00"), "smp_system_price"] == 400 - 336  # a week earlier
    assert not out.loc[t("2025-03-09 08:00"), "smp_system_price_observed"]
    assert np.isnan(out.loc[t("2025-03-01 04:30"), "load_total_mw"])
    # file 1: sums 1+2, file 2: 2+4; levels 11.5 and 21.5; averaged over files
    assert out.loc[t("2025-03-02 03:30"), "hydro_inflow_m3s"] == 4.5
    assert out.loc[t("2025-03-02 03:30"), "hydro_water_level_m"] == 16.5
    row = out.loc[t("2025-03-05 10:00")]
    assert [row[f"disp_{k}_installed_mw"] for k in ("total", "hydro", "solar", "wind")] == [1000, 2000, 3000, 4000]
    assert out.loc[t("2025-03-04 10:00"), "brent_price"] == 71.0
    assert out.loc[t("2025-03-05 10:00"), "brent_price"] == 71.0  # daily gap filled forward
    assert out.loc[t("2025-03-12 10:00"), "is_holiday"] == 1
    assert out.loc[t("2025-03-02 00:00"), "temperature_hanoi"] == 4.8
