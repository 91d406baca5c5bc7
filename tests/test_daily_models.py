import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions.clock import with_clock
from slotcast.operators import blend, daily, models, similar, slotlinear


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for s in ("a", "b"):
        ts = pd.date_range("2025-01-01", periods=48 * 40, freq="30min")
        x = rng.normal(100, 10, len(ts))
        z = np.repeat(rng.normal(0, 5, 40), 48)
        pdf = pd.DataFrame({"series_id": s, "ts": ts.astype(str), "x": x, "z": z, "y": 2 * x + z + rng.normal(0, 1, len(ts))})
        pdf.loc[rng.choice(len(ts), 30, replace=False), "x"] = None
        out.append(pdf.drop(index=[7, 8, 500]))
    pdf = pd.concat(out)
    df = with_clock(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()
    return df.toPandas(), df


def matrix(pdf, cols, scalars):
    """Days by slots the slow way."""
    out = {}
    for key, g in pdf.groupby(["series_id", "date"]):
        g = g.sort_values("cycle").set_index("cycle").reindex(range(48))
        vec = np.concatenate([g[c].ffill().bfill().fillna(0).to_numpy() for c in cols])
        out[key] = np.concatenate([vec, [g[c].dropna().iloc[0] for c in scalars]])
    return out


def test_daily_matrix_and_targets(rows):
    pdf, df = rows
    want = matrix(pdf, ["x", "y"], ["z"])
    got = daily.daily_matrix(df, ["x", "y"], ["z"]).collect()
    assert len(got) == len(want)
    for r in got:
        np.testing.assert_allclose(r.features, want[(r.series_id, r.date)])
    whole = daily.daily_targets(df).collect()
    assert len(whole) == 80 - 4
    back = daily.explode_daily(daily.daily_targets(df)).count()
    assert back == 76 * 48


def test_similar_days_against_a_loop(rows):
    pdf, df = rows
    cut = pd.Timestamp("2025-02-01").date()
    got = similar.similar_days(
        df.where(F.col("date") < F.lit(str(cut)).cast("date")), df.where(F.col("date") >= F.lit(str(cut)).cast("date")),
        ["x"], ["z"], k=7, block_days=5,
    ).toPandas()
    assert len(got) == 2 * 9 * 48
    feats = matrix(pdf, ["x"], ["z"])
    for s in ("a", "b"):
        full = {d: g.sort_values("cycle")["y"].to_numpy() for (k, d), g in pdf.groupby(["series_id", "date"]) if k == s and len(g) == 48}
        train = [d for d in full if d < cut]
        x = np.stack([feats[(s, d)] for d in train])
        q = np.quantile(x, [0.1, 0.5, 0.9], axis=0)
        scale = np.where(q[2] - q[0] > 0, q[2] - q[0], 1)
        x = (x - q[1]) / scale
        for d in sorted({d for k, d in feats if k == s and d >= cut}):
            dist = ((x - (feats[(s, d)] - q[1]) / scale) ** 2).mean(axis=1)
            near = np.argsort(dist)[:7]
            w = np.exp(-dist[near] / (np.median(dist[near]) + 1e-9))
            want = np.average(np.stack([full[train[i]] for i in near]), axis=0, weights=w)
            mine = got[(got["series_id"] == s) & (got["date"] == d)].sort_values("cycle")["pred"]
            np.testing.assert_allclose(mine, want)


def test_shrink_rows_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(90, 25)), rng.normal(size=(90, 48))
    y[:, :] += x[:, [0]] * 3 - x[:, [4]]
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    for alpha in (0.01, 0.6, 2.0):
        w = slotlinear.shrink_rows(x, y, alpha)
        grad = x.T @ (x @ w - y) / len(x)
        size = np.linalg.norm(w, axis=1)
        kept = size > 0
        np.testing.assert_allclose(grad[kept], -alpha * w[kept] / size[kept, None], atol=2e-4)
        assert (np.linalg.norm(grad[~kept], axis=1) <= alpha + 1e-6).all()
    assert set(np.flatnonzero(kept)) == {0, 4}


def test_slot_linear_learns_the_line(rows):
    pdf, df = rows
    cut = F.lit("2025-02-06").cast("date")
    model = slotlinear.fit_panel(df.where(F.col("date") < cut), ["x"], ["z"], windows=(20, None), min_days=15, holdout=(4, 6))
    stored = model.model.toPandas()
    assert sorted(stored["series_id"]) == ["a", "b"] and (stored["members"] == 2).all()
    out = slotlinear.predict_panel(model, df.where(F.col("date") >= cut), ["x"], ["z"]).toPandas()
    naive = (out["y"] - out["y"].mean()).abs().mean()
    assert (out["y"] - out["pred"]).abs().mean() < naive
    short = slotlinear.fit_panel(df, ["x"], ["z"], min_days=120)
    assert short.model.isEmpty()


def test_ridge_blend_against_normal_equations(rows, spark):
    pdf, df = rows
    clean = df.where("x is not null and series_id = 'a'").withColumn("x2", F.col("x") * F.col("x") / 100)
    folded = models.day_folds(clean, 4).cache()
    alphas = (0.01, 10.0, 1e5)
    got = blend.ridge_blend(folded, ["x", "x2", "z"], alphas=alphas).first()
    p = folded.toPandas()

    def fit(t, a):
        x, y = t[["x", "x2", "z"]].to_numpy(), t["y"].to_numpy()
        mx, my = x.mean(axis=0), y.mean()
        w = np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(3), (x - mx).T @ (y - my))
        return w, my - mx @ w

    cv = []
    for a in alphas:
        maes = []
        for k in range(1, 5):
            w, b = fit(p[p["fold"] < k], a)
            t = p[p["fold"] == k]
            maes.append(np.abs(t["y"] - (t[["x", "x2", "z"]].to_numpy() @ w + b)).mean())
        cv.append(np.mean(maes))
    assert got.alpha == alphas[int(np.argmin(cv))] and got.cv_mae == pytest.approx(min(cv), rel=1e-6)
    w, b = fit(p, got.alpha)
    np.testing.assert_allclose(got.coef, [b, *w], rtol=1e-5)


def test_day_folds_match_equal_last_blocks(rows):
    _, df = rows
    folds = models.day_folds(df, 5).select("date", "fold").distinct().toPandas().sort_values("date")
    counts = folds["fold"].value_counts().to_dict()
    assert counts == {0: 10, 1: 6, 2: 6, 3: 6, 4: 6, 5: 6}
    assert folds["fold"].is_monotonic_increasing
    with pytest.raises(Exception):
        models.day_folds(df.where("date < date'2025-01-04'"), 5).select("fold").collect()


def test_a_repeated_slot_neither_shifts_nor_completes_a_day(spark):
    rows = [("a", "2025-01-01", c, float(c)) for c in range(47)] + [("a", "2025-01-01", 3, 99.0)]
    rows += [("a", "2025-01-02", c, float(c)) for c in range(48)] + [("a", "2025-01-02", 3, 99.0)]
    df = spark.createDataFrame(rows, "series_id string, date string, cycle int, y double").selectExpr("series_id", "to_date(date) AS date", "cycle", "y")
    full = daily.daily_targets(df).collect()
    assert [str(r.date) for r in full] == ["2025-01-02"]
    assert full[0].targets == [99.0 if c == 3 else float(c) for c in range(48)]
    first = daily.daily_matrix(df, ["y"]).where("date = date'2025-01-01'").first()
    assert first.features == [99.0 if c == 3 else float(min(c, 46)) for c in range(48)]


def plain_fit(x, y, alpha):
    """The fit on all days at once: robust units, the penalised weights, back to the original units."""
    (lx, hx), (ly, hy) = (np.quantile(a, [0.1, 0.9], axis=0) for a in (x, y))
    sx, sy = np.where(hx - lx > 0, hx - lx, 1.0), np.where(hy - ly > 1e-6, hy - ly, 1.0)
    xs, ys = x / sx, y / sy
    w = slotlinear.shrink_rows(xs - xs.mean(axis=0), ys - ys.mean(axis=0), alpha) / sx[:, None] * sy
    return w, y.mean(axis=0) - x.mean(axis=0) @ w


@pytest.mark.parametrize("chunk", [7, 64])
def test_slot_linear_equals_a_plain_fit(spark, monkeypatch, chunk):
    monkeypatch.setattr(slotlinear, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    rows, data = [], {}
    for s, n in (("a", 60), ("b", 24), ("c", 9)):
        x = rng.normal(500, 60, (n, 6))
        x[:, 5] = 3.0
        y = x[:, [0]] * np.linspace(0.5, 2, 48) - x[:, [1]] * 0.3 + rng.normal(0, 15, (n, 48))
        y[:, 47] = 7.0
        data[s] = (x, y)
        rows += [(s, pd.Timestamp("2025-01-01").date() + pd.Timedelta(days=i), x[i].tolist(), y[i].tolist()) for i in range(n)]
    days = spark.createDataFrame(rows, "series_id string, date date, features array<double>, targets array<double>").repartition(4)
    windows, alphas, least, (lo, hi) = (30, None), (0.002, 0.05, 0.4), 20, (4, 6)
    model = slotlinear.SlotLinear(windows, alphas, least, (lo, hi)).fit(days)
    stored = {r.series_id: r for r in model.model.collect()}
    assert set(stored) == {"a", "b"}  # c is too short
    assert (stored["a"].members, stored["b"].members) == (2, 1)  # both windows of b are the same days
    for s, r in stored.items():
        x, y = data[s]
        parts = []
        for n in dict.fromkeys(len(x) if w is None else min(w, len(x)) for w in windows):
            wx, wy, held = x[-n:], y[-n:], min(hi, max(lo, n // 6))
            errors = []
            for a in alphas:
                w, b = plain_fit(wx[:-held], wy[:-held], a)
                errors.append(np.abs(wy[-held:] - wx[-held:] @ w - b).mean())
            best = int(np.argmin(errors))
            parts.append((alphas[best], errors[best], *plain_fit(wx, wy, alphas[best])))
        assert r.alphas == [p[0] for p in parts]
        np.testing.assert_allclose(r.errors, [p[1] for p in parts], rtol=1e-4)
        share = np.array([1 / p[1] for p in parts])
        share /= share.sum()
        np.testing.assert_allclose(np.array(r.coef).T, sum(q * p[2] for q, p in zip(share, parts)), atol=2e-3)
        got = model.transform(days.where(F.col("series_id") == s)).orderBy("date").collect()
        want = x @ sum(q * p[2] for q, p in zip(share, parts)) + sum(q * p[3] for q, p in zip(share, parts))
        np.testing.assert_allclose([g.targets for g in got], want, rtol=1e-3)
