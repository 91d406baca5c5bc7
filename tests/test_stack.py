from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.operators import models
from slotcast.plans import adaptive, stacking
from slotcast.registry import fitted
from slotcast.sources import versions

SMALL = models.TreeConfig(trees=2, depth=2, min_leaf=5)
DATA = "/root/testdata/sf0.001"


def blank():
    return stacking.Stack(
        fitted.FEATURES, ["b_1d"], trees={"one": SMALL, "two": replace(SMALL, depth=3)}, regime_config=SMALL, n_folds=2,
        neighbours=3, limits=fitted.L, min_regime_rows=20, thresholds=(0.3, 0.6), lower_cuts=(24.0, 32.0), cap_cuts=(80.0, 120.0),
        linear={"windows": (None,), "min_days": 4, "holdout": (1, 2), "alphas": (0.1,)},
        levels={"lower": (20.0, 40.0), "cap": 90.0, "min_rows": 30}, bounds={"min_rows": 10, "normal_floor": 5.0, "gate_floor": 20.0},
    )


def test_stack_forecasts_alike_after_loading(spark, tmp_path):
    train, test = fitted._train(spark, DATA)
    model = blank().fit(train)
    assert set(model.states) == set(stacking.STATES)
    model.save(str(tmp_path / "s"), spark)
    one, two = (
        m.transform(test).orderBy("series_id", "ts").select("series_id", "ts", "pred").toPandas()
        for m in (model, blank().load(str(tmp_path / "s"), spark))
    )
    assert len(one) == test.count() and one["pred"].notna().all()
    np.testing.assert_allclose(one["pred"], two["pred"])
    train.limit(1).write.mode("overwrite").parquet(str(tmp_path / "s/state/coef"))
    with pytest.raises(TypeError):
        blank().load(str(tmp_path / "s"), spark)


def test_versions_carry_settings_and_a_manifest(spark, tmp_path):
    train, test = fitted._train(spark, DATA)
    model = blank().fit(train)
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        versions.load_version(stacking.Stack, root, spark)
    scores = spark.createDataFrame([("a", 1.5)], "series_id string, mae double")
    assert versions.save_version(model, root, spark, scores) == 1
    model.save(f"{root}/2", spark)  # a driver lost before the manifest
    assert versions.versions(spark, root) == [1]
    assert versions.save_version(model, root, spark) == 3 and versions.versions(spark, root) == [1, 3]
    found = versions.read_manifest(root, spark, 1)
    assert found["scores"] == [{"series_id": "a", "mae": 1.5}] and found["settings"]["n_folds"] == 2
    assert set(found["tuned"]["iterations"]) == {"one", "two"} and {r["series_id"] for r in found["tuned"]["gate"]}
    again = versions.load_version(stacking.Stack, root, spark)
    assert (again.trees, again.limits, again.linear, again.cap_cuts) == (model.trees, model.limits, model.linear, model.cap_cuts)
    one, two = (m.transform(test).orderBy("series_id", "ts").toPandas()["pred"] for m in (model, again))
    np.testing.assert_allclose(one, two)
    with pytest.raises(TypeError):
        versions.load_version(adaptive.Adaptive, root, spark)
    with pytest.raises(FileNotFoundError):
        versions.load_version(stacking.Stack, root, spark, 2)


def test_candidates_are_subsets_of_the_base():
    stack = blank()
    assert all(set(m) <= set(stack.base) for m in stack.candidates.values())


def test_a_series_too_short_for_a_learner_keeps_its_rows(spark):
    train, test = fitted._train(spark, DATA)
    name = train.selectExpr("min(series_id) AS s").first()["s"]
    short = train.where(f"series_id <> '{name}' OR date >= date'2024-01-21'")
    got = blank().fit(short).transform(test).toPandas()
    assert len(got) == test.count() and got["pred"].notna().all()


def test_more_trees_fit_better(spark):
    train, _ = fitted._train(spark, DATA)
    errors = []
    for n in (1, 40):
        scored = models.score(models.fit_trees(train, fitted.FEATURES, "y", replace(SMALL, trees=n)), train)
        errors.append(scored.selectExpr("avg(abs(y - pred)) AS e").first()["e"])
    assert errors[1] < 0.9 * errors[0]


def rows_of_one_regime(spark):
    """Two series of 16 days, with features, that never come near the low limit."""
    wave = 60 + 20 * F.sin(F.col("cycle") * 0.13)
    noise = {c: wave + F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)) / 10.0 for c in ("y", "b_1d", "b_2d", "b_3d", "b_7d")}
    ts = F.lit("2024-01-08").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("slot") * 30).cast("int"))
    at = spark.range(2 * 16 * 48).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("series_id"), F.floor(F.col("id") / 2).alias("slot"))
    at = at.select("id", "series_id", ts.alias("ts"), (F.col("slot") % 48).cast("int").alias("cycle"))
    return at.withColumns({"date": F.col("ts").cast("date"), **noise}).drop("id")


def test_stack_without_low_rows_keeps_the_gate_shut(spark, tmp_path):
    rows = rows_of_one_regime(spark)
    day = F.lit("2024-01-22").cast("date")
    model = blank().fit(rows.where(F.col("date") < day))
    assert model.regime is None and model.tuned()["threshold"] is None
    model.save(str(tmp_path / "s"), spark)
    test = rows.where(F.col("date") >= day)
    one, two = (m.transform(test).orderBy("series_id", "ts").toPandas() for m in (model, blank().load(str(tmp_path / "s"), spark)))
    assert len(one) == 2 * 2 * 48 and one["pred"].notna().all() and (one["weight"] == 0).all()
    assert np.abs(one["pred"] - one["y"]).mean() < 10
    np.testing.assert_allclose(one["pred"], two["pred"])


def test_one_regime_has_one_forecast_and_a_shut_gate(spark, tmp_path):
    rows = rows_of_one_regime(spark)
    regime = models.TwoRegime(fitted.FEATURES, "y", SMALL, min_rows=20, limits=fitted.L)
    with pytest.raises(models.TooFewRows):
        regime.fit_calibrated(rows, 3)
    regime.fit_one(rows).save(str(tmp_path / "r"), spark)
    for m in (regime, models.TwoRegime(fitted.FEATURES, "y", SMALL, limits=fitted.L).load(str(tmp_path / "r"), spark)):
        got = m.transform(rows).toPandas()
        assert len(got) == 2 * 16 * 48 and (got["weight"] == 0).all() and (got["prob"] == 0).all()
        np.testing.assert_allclose(got["mixture"], got["normal_pred"])
        assert np.abs(got["mixture"] - got["y"]).mean() < 20
