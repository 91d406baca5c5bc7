import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions import regime as rg
from slotcast.functions.clock import with_clock
from slotcast.operators import shape, tuning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    ts = pd.date_range("2025-01-01", periods=48 * 70, freq="30min")
    level = np.where(rng.random(len(ts)) < 0.08, rng.uniform(0, 480, len(ts)), rng.uniform(700, 1800, len(ts)))
    pdf = pd.DataFrame({"series_id": "a", "ts": ts.astype(str), "y": level})
    pdf["pred"] = np.clip(pdf["y"] + rng.normal(0, 250, len(ts)), 0, 1800)
    low = (pdf["y"] <= 500).to_numpy()
    pdf["prob"] = np.clip(np.where(low, 0.7, 0.1) + rng.normal(0, 0.12, len(ts)), 0, 1)
    pdf["low_pred"] = rng.uniform(-50, 600, len(ts))
    df = with_clock(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    df = df.withColumn("weight", rg.gate_weight("prob", 0.5, 0.1)).cache()
    return df.toPandas().sort_values("ts").reset_index(drop=True), df


def test_step_bounds_and_guard_against_a_loop(rows):
    pdf, df = rows
    bounds = shape.step_bounds(df).cache()
    b = bounds.toPandas().set_index("cycle")
    prev, same = pdf["y"].shift(1), pdf["date"].eq(pdf["date"].shift(1))
    normal = same & (pdf["y"] > 500) & (prev > 500)
    delta = pdf["y"] - prev
    for c in range(48):
        mine = delta[normal & (pdf["cycle"] == c)]
        lo, hi = (mine if len(mine) >= 50 else delta[normal]).quantile([0.01, 0.99])
        assert b.loc[c, "normal_lo"] == pytest.approx(min(lo, -100)) and b.loc[c, "normal_hi"] == pytest.approx(max(hi, 100))
        gate = delta[same & ~normal & (pdf["cycle"] == c)]
        lo, hi = (gate if len(gate) >= 50 else delta[same & ~normal]).quantile([0.005, 0.995])
        assert b.loc[c, "gate_lo"] == pytest.approx(min(lo, -500)) and b.loc[c, "gate_hi"] == pytest.approx(max(hi, 500))
    tight = bounds.select("series_id", "cycle", *[(F.col(c) / 3).alias(c) for c in ("normal_lo", "normal_hi", "gate_lo", "gate_hi")])
    got = shape.step_guard(df, tight).toPandas().sort_values("ts")["guarded"].to_numpy()
    want = pdf["pred"].to_numpy().copy()
    w = pdf["weight"].to_numpy()
    for i in range(1, len(want)):
        if pdf["date"][i] == pdf["date"][i - 1]:
            gate = max(w[i], w[i - 1]) >= 0.2 or abs(w[i] - w[i - 1]) >= 0.2
            side = "gate" if gate else "normal"
            lo, hi = b.loc[pdf["cycle"][i], f"{side}_lo"] / 3, b.loc[pdf["cycle"][i], f"{side}_hi"] / 3
            want[i] = want[i - 1] + np.clip(want[i] - want[i - 1], lo, hi)
    np.testing.assert_allclose(got, want)
    assert np.abs(want - pdf["pred"]).max() > 1


def test_gate_grid_against_a_loop(rows):
    pdf, df = rows
    grid = tuning.gate_grid(df.withColumn("normal", F.col("pred"))).toPandas()
    y, p = pdf["y"], pdf["prob"]
    clean, low_pred = (y > 500) & (y < 2500), pdf["low_pred"].clip(0, 500)
    base = (y - pdf["pred"]).abs()
    best, pick = base.mean(), (1.1, 0.05)
    for t in tuning.GATE_THRESHOLDS:
        for r in tuning.GATE_RAMPS:
            w = (p >= t).astype(float) if r == 0 else ((p - (t - r)) / (2 * r)).clip(0, 1)
            e = (y - ((1 - w) * pdf["pred"] + w * low_pred)).abs()
            row = grid[(grid["threshold"] == t) & (grid["ramp"] == r)].iloc[0]
            assert row["clean_mae"] == pytest.approx(e[clean].mean()) and row["overall_mae"] == pytest.approx(e.mean())
            if e[clean].mean() <= base[clean].mean() + 2.5 and e.mean() < best:
                best, pick = e.mean(), (t, r)
    chosen = tuning.best_gate(tuning.gate_grid(df.withColumn("normal", F.col("pred")))).first()
    assert (chosen.threshold, chosen.ramp) == pick and pick[0] < 1


def test_gate_grid_at_breaks_and_without_them(spark):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({
        "series_id": np.where(np.arange(n) < 450, "a", "b"), "y": rng.choice([100.0, 400.0, 900.0, 2600.0], n), "normal": rng.choice([100.0, 450.0, 1000.0], n),
        "low_pred": rng.choice([-50.0, 100.0, 450.0, 700.0], n), "prob": rng.choice([0.0, 0.15, 0.3, 0.31, 0.5, 0.7, 1.0, *rng.random(5)], n),
    })
    thresholds, ramps = (0.7, 0.15, 0.3, 0.31, 1.2), (0.0, 0.02, 0.15, 0.4)
    gaps = pdf.head(1).assign(prob=None)
    df = spark.createDataFrame(pd.concat([pdf, gaps])).withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))
    grid = tuning.gate_grid(df, thresholds=thresholds, ramps=ramps).toPandas()
    assert len(grid) == 2 * (1 + len(thresholds) * len(ramps))
    for s, g in pdf.groupby("series_id"):
        y, low = g["y"], g["low_pred"].clip(0, 500)
        groups = {"overall_mae": y > -1, "clean_mae": (y > 500) & (y < 2500), "low_mae": y <= 500}
        for t in thresholds:
            for r in ramps:
                w = 0.0 * y if t > 1 else (g["prob"] >= t).astype(float) if r == 0 else ((g["prob"] - (t - r)) / (2 * r)).clip(0, 1)
                e = (y - ((1 - w) * g["normal"] + w * low)).abs()
                row = grid[(grid["series_id"] == s) & (grid["threshold"] == t) & (grid["ramp"] == r)].iloc[0]
                for name, inside in groups.items():
                    assert row[name] == pytest.approx(e[inside].mean(), abs=1e-7)
        off = grid[(grid["series_id"] == s) & grid["threshold"].isna()].iloc[0]
        assert off["overall_mae"] == pytest.approx((y - g["normal"]).abs().mean())


def test_threshold_sweep_against_a_loop(rows):
    pdf, df = rows
    sweep = tuning.threshold_sweep(df, rg.is_low("y"), "prob")
    event = pdf["y"] <= 500
    least, best, pick = max(0.25, min(0.6, 1.5 * event.mean())), None, 1.1
    got = sweep.toPandas().set_index("threshold")
    for t in tuning.SWEEP:
        called = pdf["prob"] >= t
        tp, fp, fn = (event & called).sum(), (~event & called).sum(), (event & ~called).sum()
        precision, recall, fpr = tp / max(tp + fp, 1), tp / max(tp + fn, 1), fp / max((~event).sum(), 1)
        f2 = 5 * precision * recall / max(4 * precision + recall, 1e-12)
        assert got.loc[t, "f2"] == pytest.approx(f2) and got.loc[t, "fpr"] == pytest.approx(fpr)
        if precision >= least and fpr <= 0.0025 and (best is None or (f2, recall, precision, -t) > best):
            best, pick = (f2, recall, precision, -t), t
    assert tuning.best_threshold(sweep).first()["threshold"] == pick and pick < 1


def test_projection_grid_against_a_loop(rows):
    pdf, df = rows
    levels = tuning.state_levels(df)
    lv = levels.first()
    y = pdf["y"]
    low, cap = y[(y > 500) & (y < 1200)].median(), y[y >= 1700].median()
    assert (lv.lower_value, lv.cap_value) == (low, cap)
    got = tuning.projection_grid(df, levels)
    grid = {(r.lower_cut, r.cap_cut): r for r in got.collect()}
    clean, outside = (y > 500) & (y < 2500), pdf["weight"] < 0.2
    month = pd.to_datetime(pdf["date"]).dt.to_period("M")
    base = (y - pdf["pred"]).abs()
    base_month = base[clean].groupby(month[clean]).mean()
    best = None
    for lo in (None, *tuning.LOWER_CUTS):
        for hi in (None, *tuning.CAP_CUTS):
            if lo is not None and hi is not None and lo >= hi:
                assert (lo, hi) not in grid
                continue
            p = pdf["pred"].copy()
            if lo is not None:
                p[outside & (p <= lo)] = low
            if hi is not None:
                p[outside & (p >= hi)] = cap
            e = (y - p).abs()
            r = grid[(lo, hi)]
            better = int((e[clean].groupby(month[clean]).mean() <= base_month + 1e-12).sum())
            assert r.clean_mae == pytest.approx(e[clean].mean()) and r.overall_mae == pytest.approx(e.mean())
            assert (r.months_ok, r.months) == (better, len(base_month))
            if (lo, hi) != (None, None) and e[clean].mean() < base[clean].mean() and e.mean() <= base.mean() and better >= np.ceil(0.6 * len(base_month)):
                if best is None or e[clean].mean() < best[0] - 1e-9:
                    best = (e[clean].mean(), lo, hi)
    chosen = tuning.best_projection(got).collect()
    assert [(c.lower_cut, c.cap_cut) for c in chosen] == ([(best[1], best[2])] if best else [])


def test_slot_bias_is_shrunk_and_clipped(rows):
    pdf, df = rows
    got = shape.slot_bias(df).toPandas().set_index("cycle")["slot_bias"]
    clean = pdf[(pdf["y"] > 500) & (pdf["y"] < 2500)]
    for c, g in clean.groupby("cycle"):
        want = np.clip(len(g) / (len(g) + 96) * (g["y"] - g["pred"]).median(), -40, 40)
        assert got[c] == pytest.approx(want)
