"""Leaf values fitted again, shared training tables, parallel fits."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from slotcast.functions.clock import with_clock
from slotcast.limits import Limits
from slotcast.operators import leaves, models

CONFIG = models.TreeConfig(trees=12, depth=3, min_leaf=5, refit=4)
PLAIN = replace(CONFIG, refit=0)
FEATURES = ["x", "slot"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    parts = []
    for s, scale in (("a", 1.0), ("b", 1.5)):
        ts = pd.date_range("2025-01-01", periods=48 * 24, freq="30min")
        x = rng.normal(0, 1, len(ts))
        y = 900 + scale * (200 * np.sign(x) + 80 * np.abs(x)) + rng.standard_t(2, len(ts)) * 10
        y[rng.random(len(ts)) < 0.04] = 150
        parts.append(pd.DataFrame({"series_id": s, "ts": ts.astype(str), "x": x, "y": y}))
    df = with_clock(spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    return df.withColumn("slot", F.col("cycle").cast("double")).cache()


def weighted_error(model, df, y="y"):
    scored = models.score(model, df)
    return scored.agg(F.sum(F.col("weight") * F.abs(F.col(y) - F.col("pred"))) / F.sum("weight")).first()[0]


def test_medians_of_residuals_stay_close_to_exact_ones(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({"r": np.concatenate([rng.normal(0, 1, n - 3), [1e9, -1e9, 0.0]]), "weight": rng.uniform(0.1, 2, n), "a": rng.integers(0, 3, n), "b": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf).withColumn("leaves", F.array(F.col("a").cast("int"), F.col("b").cast("int")))
    got = {(t, leaf): m for t, leaf, m in leaves.medians(df, range(0, 2)).collect()}
    for t, col in enumerate("ab"):
        for leaf, g in pdf.groupby(col):
            g = g.sort_values("r")
            below = g["weight"].cumsum()
            exact = g["r"][below >= g["weight"].sum() / 2].iloc[0]
            assert got[t, leaf] == pytest.approx(exact, rel=0.02, abs=2e-4)


def test_a_single_tree_gets_its_leaves_medians(rows):
    one = replace(CONFIG, trees=1, refit=1)
    weighted = models.with_recency(rows, one.half_life_days)
    model = models.fit_trees(weighted, FEATURES, config=one)
    ensemble, last = model.stages[1], model.stages[2]
    p = model.transform(weighted).select("y", "weight", leaves.leaf_array("__leaves_pred").alias("leaves")).toPandas()
    p["leaf"] = p["leaves"].str[0]
    values = {r.leaf: r.value for r in last.table(rows.sparkSession).collect()}
    assert len(values) == len(leaves.plain_values(ensemble)[0]) > 2
    spread, center = last.getOrDefault(last.spread), last.getOrDefault(last.center)
    for leaf, g in p.groupby("leaf"):
        g = g.sort_values("y")
        exact = g["y"][g["weight"].cumsum() >= g["weight"].sum() / 2].iloc[0]
        assert values[leaf] + center == pytest.approx(exact, abs=0.03 * spread)


def test_refit_lowers_the_error_and_plain_values_are_the_ensembles(rows):
    weighted = models.with_recency(rows, CONFIG.half_life_days).cache()
    errors = {}
    for n in (3, 12):
        for block in (0, 1, 4):
            errors[n, block] = weighted_error(models.fit_trees(weighted, FEATURES, config=replace(CONFIG, trees=n, refit=block)), weighted)
        assert max(errors[n, 1], errors[n, 4]) < errors[n, 0]
    plain = models.fit_trees(weighted, FEATURES, config=PLAIN)
    # without refit the table of leaves gives what the booster itself predicts
    scored = plain.transform(weighted)
    center, spread = models.target_scale(weighted, "y")
    off = scored.agg(F.max(F.abs(F.col("pred") - (F.col("__pred") * spread + center)))).first()[0]
    assert off < 1e-6


def test_held_rows_judge_the_values(rows):
    weighted = models.with_recency(rows, CONFIG.half_life_days).withColumn("held", F.col("date") >= F.lit("2025-01-20").cast("date")).cache()
    held = weighted.where("held")
    refitted, plain = (models.fit_trees(weighted, FEATURES, config=c, validation="held") for c in (CONFIG, PLAIN))
    assert weighted_error(refitted, held) <= weighted_error(plain, held) + 1e-6


def test_values_are_saved_with_the_pipeline(rows, tmp_path):
    model = models.fit_trees(rows, FEATURES, config=CONFIG)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one, two = (models.score(m, rows).orderBy("series_id", "ts").toPandas()["pred"] for m in (model, again))
    np.testing.assert_array_equal(one, two)
    assert models.leaf_values(again).by_tree() == models.leaf_values(model).by_tree()


def test_windows_on_one_table_equal_fits_of_their_own(rows):
    fitted = models.fit_windows(rows, FEATURES, "2025-01-21 00:00:00", (5, 12, 400), "y", CONFIG, 100, Limits(low=200.0))
    assert list(fitted) == ["trees_5d", "trees_12d", "trees_400d"]
    own = rows.where("ts < timestamp_ntz'2025-01-21 00:00:00' AND ts >= timestamp_ntz'2025-01-09 00:00:00' AND y > 200 AND y < 2500")
    alone = models.fit_trees(own, FEATURES, config=replace(CONFIG, seed=CONFIG.seed + 1), out="own")
    both = models.score_all({"a": fitted["trees_12d"], "b": alone}, rows)
    assert both.agg(F.max(F.abs(F.col("trees_12d") - F.col("own")))).first()[0] < 1e-6
    assert list(models.fit_windows(rows, FEATURES, "2025-01-02 00:00:00", (5,), "y", CONFIG, 1000)) == []


def test_folds_on_one_table_see_only_earlier_days(rows):
    folded = models.day_folds(rows, 3).cache()
    out = models.out_of_fold(folded, FEATURES, {"m": CONFIG})
    changed = folded.withColumn("y", F.when(F.col("fold") == 3, F.col("y") * 7).otherwise(F.col("y")))
    again = models.out_of_fold(changed, FEATURES, {"m": CONFIG})
    keys = ["series_id", "ts"]
    j = out.select(*keys, "fold", "m").join(again.select(*keys, F.col("m").alias("n")), keys)
    assert j.count() == folded.where("fold > 0").count()
    assert j.agg(F.max(F.abs(F.col("m") - F.col("n")))).first()[0] < 1e-6


def test_jobs_of_a_pool_keep_their_names_and_errors(spark):
    found = models.in_parallel(spark, {str(i): (lambda n=i: spark.range(n).count()) for i in range(6)}, 3)
    assert found == {str(i): i for i in range(6)}
    with pytest.raises(ZeroDivisionError):
        models.in_parallel(spark, {"a": lambda: 1 / 0})


def test_regime_stops_early_on_held_rows(rows):
    held = rows.withColumn("late", F.col("date") >= F.lit("2025-01-18").cast("date"))
    config = replace(CONFIG, trees=40, depth=4)
    limits = Limits(low=200.0)
    stopped = models.TwoRegime(FEATURES, "y", config, min_rows=20, limits=limits).fit(held, "late")
    free = models.TwoRegime(FEATURES, "y", config, min_rows=20, limits=limits).fit(rows)
    sizes = [{n: len(models.trees_of(m).trees) for n, m in r.models.items()} for r in (stopped, free)]
    assert set(sizes[0]) == {"classifier", "low", "normal"} and all(v == 40 for v in sizes[1].values())
    assert all(v <= 40 for v in sizes[0].values()) and sum(sizes[0].values()) < 120
    with pytest.raises(models.TooFewRows):
        models.TwoRegime(FEATURES, "y", config, min_rows=10**6, limits=limits).fit(rows)
