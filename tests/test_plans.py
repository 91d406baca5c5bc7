from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast.functions.clock import with_clock
from slotcast.limits import Limits
from slotcast.operators import metrics, models, policy
from slotcast.plans import adaptive, evaluate, pretest, serve

CONFIG = models.TreeConfig(trees=3, depth=3, min_leaf=5)
FEATURES = ["lag", "slot"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    parts = []
    for start in ("2023-12-10", "2024-12-20"):
        ts = pd.date_range(start, periods=48 * 32, freq="30min")
        y = 1000 + 300 * np.sin(ts.hour.to_numpy() / 24 * 2 * np.pi) + rng.normal(0, 60, len(ts))
        y[rng.random(len(ts)) < 0.12] = 200
        parts.append(pd.DataFrame({"series_id": "a", "ts": ts.astype(str), "y": y, "lag": y + rng.normal(0, 80, len(ts))}))
    df = with_clock(spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df.withColumn("slot", F.col("cycle").cast("double")).write.parquet(path)
    return spark.read.parquet(path)


def two_regime():
    return models.TwoRegime(FEATURES, "y", CONFIG, fit_normal=False, min_rows=50)


def test_pretest_sweeps_fits_and_chooses(spark, rows):
    summary, all_rows = pretest.run_pretest(
        rows, FEATURES, years=(2024, 2025), windows=(10, 20), config=CONFIG, regime=two_regime(), first_year=2023,
        configs=((0, 0, None), (7, 14, 0.95)),
    )
    m = all_rows.toPandas()
    names = {c.split("|")[0] for c in m["candidate"]}
    base = {"trees_10d", "trees_20d", "adaptive_median", "online_average"}
    assert names == base | {f"gated_{b}" for b in base}
    assert set(m["year"]) == {2024, 2025} and len(m) == 2 * 2 * 8
    s = summary.first()
    assert s.candidate.startswith(s.base_candidate) and s.years == 2
    per = m.assign(r=np.maximum(m["clean_mae"] / 150, m["clean_wmape"] / 10)).groupby("candidate").agg(r=("r", "max"), w=("wmape", "max"))
    near = per[per["r"] <= per["r"].min() + 0.01].sort_values(["w", "r"])
    assert s.candidate == near.index[0]


def test_pretest_guards():
    with pytest.raises(ValueError):
        pretest.guard_years((2025, 2026))
    with pytest.raises(ValueError):
        pretest.guard_years(())


def test_adaptive_saves_loads_and_serves(spark, rows, tmp_path):
    late = rows.where("date >= date'2024-12-20'")
    train, target = late.where("date < date'2025-01-20'"), late.where("date = date'2025-01-20'")
    model = adaptive.Adaptive(
        FEATURES, "gated_online_average", windows=(10, 20), bias_days=5, cap_days=10, cap_ratio=0.95, config=CONFIG
    ).fit(train, two_regime())
    assert set(model.trees) == {"trees_10d", "trees_20d"} and model.regime is not None
    model.regime.threshold = 0.5
    one = model.day_ahead(target, train).orderBy("ts").toPandas()
    assert len(one) == 48 and one["pred"].between(0, 1778.6).all()
    model.limits, model.windows = replace(model.limits, high=2000.0), (10, 20)
    model.save(str(tmp_path / "m"), spark)
    again = adaptive.Adaptive.load(str(tmp_path / "m"), spark).day_ahead(target, train).orderBy("ts").toPandas()
    np.testing.assert_allclose(one["pred"], again["pred"])
    walked = model.walk_forward(late, None)
    assert walked.count() == late.count()
    with pytest.raises(ValueError):
        adaptive.Adaptive(FEATURES, "nonsense", windows=(10,), config=CONFIG, trees=model.trees).transform(target)
    (tmp_path / "other").mkdir()
    rows.limit(1).write.parquet(str(tmp_path / "other/settings"))
    with pytest.raises(TypeError):
        adaptive.Adaptive.load(str(tmp_path / "other"), spark)


def test_regime_needs_rows_of_both_kinds(rows):
    with pytest.raises(ValueError):
        models.TwoRegime(FEATURES, "y", CONFIG).fit(rows.where("y > 500"))


def test_evaluate_writes_every_table(spark, rows, tmp_path):
    df = rows.withColumns({"pred": F.col("lag"), "prob": F.lit(0.3), "weight": F.when(F.col("lag") < 500, 1.0).otherwise(0.0)})
    out = str(tmp_path / "eval")
    manifest = evaluate.manifest_row(metrics.metrics(df, ["series_id"]), candidate="x", bias_days=7)
    tables = evaluate.evaluate(df, lag="lag", weight="weight", prob="prob", manifest=manifest, out=out)
    s = tables["summary"].first()
    assert s.samples == rows.count() and s.gate_recall > 0.9 and s.baseline_mae == pytest.approx(s.clean_mae)
    assert spark.read.csv(f"{out}/metrics_by_cycle", header=True).count() == 48
    assert spark.read.csv(f"{out}/metrics_by_month", header=True).count() == 4
    assert spark.read.parquet(f"{out}/predictions").count() == s.samples
    assert spark.read.parquet(f"{out}/regime_events").count() == s.samples
    assert spark.read.json(f"{out}/manifest").first().settings.bias_days == 7
    assert spark.read.json(f"{out}/summary").first().samples == s.samples
    by_hand = metrics.metrics(rows.withColumn("pred", F.greatest(F.least("lag", F.lit(1778.6)), F.lit(0.0))), ["series_id"]).first()
    assert s.mae == pytest.approx(by_hand.mae)


def test_serving_contract(spark, contract):
    with pytest.raises(ValueError, match="absent"):
        policy.require_complete(contract, ["nope"])
    with pytest.raises(ValueError, match="missing"):
        policy.require_complete(contract.withColumn("f", F.when(F.col("cycle") > 0, 1.0)), ["f"])
    with pytest.raises(ValueError, match="before the origin"):
        policy.require_fresh(contract, serve.origin_ts("2025-02-10", 15), "smp_system_price")
    policy.require_fresh(contract, serve.origin_ts("2025-02-09", 15), "smp_system_price")
    full = serve.future_frame(contract, "2025-02-08")
    day = full.where("date = date'2025-02-09'").toPandas()
    assert len(day) == 48 and day["smp_system_price"].isna().all() and day["disp_total_installed_mw"].nunique() == 1
    assert full.where("date = date'2025-02-08' and smp_system_price is not null").count() == 16
    assert full.groupBy("series_id", "ts").count().where("count > 1").count() == 0


def test_trailing_limits_are_parameters(spark, rows):
    m = metrics.metrics(rows, ["series_id"], "y", "lag", limits=Limits(low=900.0, high=1100.0)).first()
    assert m.low_samples == rows.where("y <= 900").count() and m.clean_samples == rows.where("y > 900 and y < 1100").count()
