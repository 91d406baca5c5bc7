"""Model fitting on Spark ML. One model is fitted on the pooled rows of all series.

Fits are distributed over rows. Windows, folds and configurations are a handful of fits on one written
table, started from the driver a few at a time; nothing but settings, target scales and leaf values passes through it.
"""

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.regime import gate_blend, gate_weight, is_clean, is_low, soft_mixture
from slotcast.functions.weights import recency_weight
from slotcast.limits import Limits
from slotcast.operators import leaves, tuning
from slotcast.sources.shared import drop_tables, settle
from slotcast.sources.writers import load_table, save_table

# fixed values
WINDOW_DAYS = (45, 60, 90, 180, 365, 730, 1460)
MIN_WINDOW_ROWS = 256
MIN_REGIME_ROWS = 100
PARALLEL = 8
# trees a block in the production settings
REFIT = 10


@dataclass(frozen=True)
class TreeConfig:
    """Settings of one boosted-tree fit with absolute loss; ``refit``: trees a block whose leaves get medians, 0 for none."""

    trees: int = 100
    depth: int = 5
    step: float = 0.1
    subsample: float = 1.0
    min_leaf: int = 30
    features: str = "all"
    seed: int = 42
    half_life_days: float = 180.0
    refit: int = 0


# Three differently shaped learners for the stack.
STACK_TREES = {
    "deep": TreeConfig(depth=8, step=0.05, min_leaf=20, features="0.8", half_life_days=730.0, refit=REFIT),
    "sampled": TreeConfig(depth=6, step=0.05, subsample=0.8, features="0.7", half_life_days=730.0, refit=REFIT),
    "shallow": TreeConfig(depth=4, step=0.1, half_life_days=730.0, refit=REFIT),
}


class TooFewRows(ValueError):
    """A model has too few rows to be fitted; callers may go on without it."""


def in_parallel(spark: SparkSession, jobs: dict[str, Callable], workers: int = PARALLEL) -> dict:
    """Results of independent jobs by name, a few at a time, each in a scheduler pool of its own."""

    def run(name: str, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(workers, len(jobs)))) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(partial(run, name, job))) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def with_recency(df: DataFrame, half_life_days: float, out: str = "weight") -> DataFrame:
    """Weight of each row by its age against the newest row of its series."""
    newest = df.groupBy("series_id").agg(F.max("ts").alias("__newest"))
    weighted = df.join(newest, "series_id").withColumn(out, recency_weight("ts", "__newest", half_life_days))
    return weighted.drop("__newest")


def with_fold_recency(folded: DataFrame, half_life_days: float) -> DataFrame:
    """``w1`` .. ``wn``: weight of each row by its age against the newest row of its series in the folds before 1 .. n."""
    n = folded.agg(F.max("fold").alias("n")).first()["n"] or 0
    newest = folded.groupBy("series_id").agg(F.array(*[F.max(F.when(F.col("fold") < k, F.col("ts"))) for k in range(1, n + 1)]).alias("__newest"))
    weights = {f"w{k}": F.least(recency_weight("ts", F.get("__newest", F.lit(k - 1)), half_life_days), F.lit(1.0)) for k in range(1, n + 1)}
    return folded.join(newest, "series_id").withColumns(weights).drop("__newest")


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")


def training_table(rows: DataFrame, features: list[str], y: str, keep: list[str], paths: list[str]) -> DataFrame:
    """What fits read, written once: assembled features, target, and the columns that say which rows a fit takes."""
    used = dict.fromkeys([y, *keep])
    return settle(assembler(features).transform(rows).select("__x", *used), "training", paths)


def _gbt(kind, c: TreeConfig, label: str, validation: str | None, out: str, weight: str = "weight"):
    est = kind(
        labelCol=label, predictionCol=out, weightCol=weight, maxIter=c.trees, maxDepth=c.depth, stepSize=c.step, featuresCol="__x",
        subsamplingRate=c.subsample, minInstancesPerNode=c.min_leaf, featureSubsetStrategy=c.features, seed=c.seed,
    )
    return est.setValidationIndicatorCol(validation) if validation else est


def _quantiles(y: str, inside=None):
    value = F.col(y) if inside is None else F.when(inside, F.col(y))
    return F.percentile_approx(value, [0.1, 0.5, 0.9], 10000)


def _scale(quantiles) -> tuple[float, float]:
    low, center, high = quantiles or (0.0, 0.0, 0.0)
    return float(center), float(high - low) or 1.0


def target_scales(df: DataFrame, y: str, parts: dict) -> dict[str, tuple[float, float]]:
    """Median and spread between the 10 and 90 per cent quantiles (1 for a constant target) of each part, in one pass."""
    found = df.agg(*[_quantiles(y, inside).alias(str(i)) for i, inside in enumerate(parts.values())]).first()
    return {name: _scale(q) for name, q in zip(parts, found)}


def target_scale(df: DataFrame, y: str) -> tuple[float, float]:
    return target_scales(df, y, {"all": F.lit(True)})["all"]


def fit_table(
    table: DataFrame, features: list[str], y: str, config: TreeConfig, scale: tuple[float, float], out: str = "pred",
    validation: str | None = None, weight: str = "weight",
) -> PipelineModel:
    """Boosted trees on rows of a `training_table`; the pipeline starts from the feature columns.

    A gradient of the absolute error is a sign, so a tree moves a forecast by one step of the
    target's unit at most. The target is therefore fitted in units of its own spread. The leaves' values are
    then fitted again to the residuals' medians, ``config.refit`` trees at a time (0: not at all).
    """
    center, spread = scale
    scaled = table.withColumn("__y", (F.col(y) - center) / spread)
    est = _gbt(GBTRegressor, config, "__y", validation, f"__{out}", weight).setLossType("absolute").setLeafCol(f"__leaves_{out}")
    model = est.fit(scaled)
    values = leaves.plain_values(model)
    if config.refit:
        paths: list[str] = []
        held = F.col(validation) if validation else F.lit(False)
        keyed = model.transform(scaled).select(
            F.col("__y").alias("y"), F.col(weight).alias("weight"), leaves.leaf_array(f"__leaves_{out}").alias("leaves"), held.alias("held")
        )
        values = leaves.refit(settle(keyed, "leaves", paths), values, config.refit, validation is not None)
        drop_tables(table.sparkSession, paths)
    last = leaves.LeafValues(leavesCol=f"__leaves_{out}", outputCol=out, values=json.dumps(values), center=center, spread=spread)
    return PipelineModel([assembler(features), model, last])


def fit_trees(
    df: DataFrame, features: list[str], y: str = "y", config: TreeConfig = TreeConfig(), validation: str | None = None, out: str = "pred"
) -> PipelineModel:
    """Weighted absolute-error boosted trees; rows flagged by ``validation`` stop it early and judge its leaf values.

    A column ``weight`` in ``df`` is kept, else it is the recency of the row. The rows are written once, as many passes follow.
    """
    rows = df if "weight" in df.columns else with_recency(df, config.half_life_days)
    paths: list[str] = []
    table = training_table(rows, features, y, ["weight"] + ([validation] if validation else []), paths)
    fitted = fit_table(table, features, y, config, target_scale(table, y), out, validation)
    drop_tables(df.sparkSession, paths)
    return fitted


def trees_of(model: PipelineModel):
    """The tree ensemble of a fitted pipeline."""
    return next(s for s in model.stages if hasattr(s, "trees"))


def leaf_values(model: PipelineModel) -> leaves.LeafValues:
    """The stage that holds the leaf values."""
    return next(s for s in model.stages if isinstance(s, leaves.LeafValues))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Forecast column added, working columns dropped."""
    working = ["__x"]
    for s in model.stages:
        if hasattr(s, "trees") and s.getPredictionCol() != "__called":
            working += [s.getPredictionCol(), s.getLeafCol()]
    return model.transform(df).drop(*working)


def fit_windows(
    df: DataFrame,
    features: list[str],
    start,
    windows=WINDOW_DAYS,
    y: str = "y",
    config: TreeConfig = TreeConfig(refit=REFIT),
    min_rows: int = MIN_WINDOW_ROWS,
    limits: Limits = Limits(),
) -> dict[str, PipelineModel]:
    """One model per trailing window of clean rows before ``start``; short windows are skipped.

    All windows read one written table; one pass over it counts and scales them, and the fits run side by side.
    """
    origin = F.lit(str(start)).cast("timestamp_ntz")

    def inside(days: int):
        return F.col("ts") >= origin - F.make_dt_interval(days=F.lit(days))

    paths: list[str] = []
    clean = df.where((F.col("ts") < origin) & inside(max(windows)) & is_clean(y, limits))
    table = training_table(with_recency(clean, config.half_life_days), features, y, ["ts", "weight"], paths)
    found = table.agg(*[F.count_if(inside(d)).alias(f"n{d}") for d in windows], *[_quantiles(y, inside(d)).alias(f"q{d}") for d in windows]).first()
    jobs = {}
    for i, d in enumerate(windows):
        if (found[f"n{d}"] or 0) >= min_rows:
            own = replace(config, seed=config.seed + i)
            jobs[f"trees_{d}d"] = partial(fit_table, table.where(inside(d)), features, y, own, _scale(found[f"q{d}"]), f"trees_{d}d")
    fitted = in_parallel(df.sparkSession, jobs)
    drop_tables(df.sparkSession, paths)
    return fitted


def score_all(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """One forecast column per model, all computed in the same pass over ``df``."""
    for m in models.values():
        df = score(m, df)
    return df


def day_folds(df: DataFrame, n: int = 5) -> DataFrame:
    """``fold``: 1..n for the n equal validation blocks of last days, 0 for the days before them.

    Fold k is validated on ``fold = k`` and trained on ``fold < k``. The distinct dates of
    all series fit one row, as the calendar bounds them; the panel is not sorted.
    """
    dates = df.agg(F.array_sort(F.collect_set("date")).alias("all")).select(
        F.size("all").alias("total"), F.posexplode("all").alias("pos", "date")
    )
    size = F.floor(F.col("total") / (n + 1))
    few = F.raise_error(F.lit(f"{n} folds need at least {n + 1} days"))
    fold = F.greatest(F.lit(0), F.floor((F.col("pos") - (F.col("total") - n * size)) / size) + 1)
    ranked = dates.select("date", F.when(size >= 1, fold).otherwise(few).cast("int").alias("fold"))
    return df.join(ranked, "date")


def fold_jobs(table: DataFrame, features: list[str], configs: dict[str, TreeConfig], y: str, scales: dict, held: bool = False) -> dict[str, Callable]:
    """The fits of all folds and configurations on one table with ``fold`` and ``w1`` ..; ``held``: fold k stops fit k early."""
    jobs = {}
    for k in range(1, len(scales) + 1):
        rows = table.where(F.col("fold") <= k).withColumn("__held", F.col("fold") == k) if held else table.where(F.col("fold") < k)
        for name, c in configs.items():
            jobs[f"{k} {name}"] = partial(fit_table, rows, features, y, c, scales[f"fold{k}"], name, "__held" if held else None, f"w{k}")
    return jobs


def fit_folds(folded: DataFrame, features: list[str], configs: dict[str, TreeConfig], y: str, held: bool = False) -> dict[tuple[int, str], PipelineModel]:
    """Models by fold and name; configurations of one half-life share one written table and one pass for the scales."""
    fitted = {}
    for half_life in dict.fromkeys(c.half_life_days for c in configs.values()):
        paths: list[str] = []
        weighted = with_fold_recency(folded, half_life)
        weights = [c for c in weighted.columns if c not in folded.columns]
        table = training_table(weighted, features, y, ["fold", *weights], paths)
        scales = target_scales(table, y, {f"fold{k}": F.col("fold") < k for k in range(1, len(weights) + 1)})
        same = {m: c for m, c in configs.items() if c.half_life_days == half_life}
        found = in_parallel(folded.sparkSession, fold_jobs(table, features, same, y, scales, held))
        fitted |= {(int(name.split(" ", 1)[0]), name.split(" ", 1)[1]): m for name, m in found.items()}
        drop_tables(folded.sparkSession, paths)
    return fitted


def out_of_fold(folded: DataFrame, features: list[str], configs: dict[str, TreeConfig], y: str = "y") -> DataFrame:
    """Forecasts of every validation fold by models that saw only earlier folds, one column per model."""
    fitted = fit_folds(folded, features, configs, y)
    folds = sorted({k for k, _ in fitted})
    parts = [score_all({m: fitted[k, m] for m in configs}, folded.where(F.col("fold") == k)) for k in folds]
    return reduce(DataFrame.unionByName, parts)


def low_counts(df: DataFrame, y: str, limits: Limits):
    """Rows of the low regime and of the other."""
    return df.agg(F.count_if(is_low(y, limits)).alias("low"), F.count_if(~is_low(y, limits)).alias("high")).first()


@dataclass
class TwoRegime:
    """Low-regime classifier with one regressor per regime and a gate between them."""

    features: list[str]
    y: str = "y"
    config: TreeConfig = TreeConfig(depth=6, step=0.1, refit=REFIT)
    fit_normal: bool = True
    min_rows: int = MIN_REGIME_ROWS
    limits: Limits = Limits()
    threshold: float = 1.1
    ramp: float = 0.0
    models: dict | None = None

    def fit(self, df: DataFrame, validation: str | None = None) -> "TwoRegime":
        """Fit on all rows; both regimes need ``min_rows``. Rare events are weighted up, at most 20 times.

        Rows flagged by ``validation`` are not trained on: they stop all three fits early. The fits share one written
        table and run side by side.
        """
        held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
        low = is_low(self.y, self.limits)
        flagged = with_recency(df, self.config.half_life_days).withColumns({"__low": low.cast("double"), "__held": held})
        paths: list[str] = []
        table = training_table(flagged, self.features, self.y, ["weight", "__low", "__held"], paths)
        parts = {"low": F.col("__low") == 1} | ({"normal": F.col("__low") == 0} if self.fit_normal else {})
        free = ~F.col("__held")
        found = table.agg(
            F.count_if(free & (F.col("__low") == 1)).alias("low"), F.count_if(free & (F.col("__low") == 0)).alias("high"),
            *[F.count_if(F.col("__held") & inside).alias(f"held_{name}") for name, inside in parts.items()],
            *[_quantiles(self.y, free & inside).alias(f"q_{name}") for name, inside in parts.items()],
        ).first()
        if min(found["low"], found["high"]) < self.min_rows:
            raise TooFewRows(f"both regimes need at least {self.min_rows} rows, got {found['low']} and {found['high']}")
        balance = min(max(found["high"] / found["low"], 1.0), 20.0)
        stop = "__held" if validation and any(found[f"held_{name}"] for name in parts) else None
        boosted = table.withColumn("weight", F.col("weight") * F.when(F.col("__low") == 1, balance).otherwise(1.0))
        clf = _gbt(GBTClassifier, self.config, "__low", stop, "__called")
        clf = clf.setProbabilityCol("__probs").setRawPredictionCol("__raw")
        jobs = {"classifier": lambda: PipelineModel([assembler(self.features), clf.fit(boosted)])}
        for name, inside in parts.items():
            # a fit is only stopped by held rows of its own regime
            own = "__held" if found[f"held_{name}"] else None
            jobs[name] = partial(fit_table, table.where(inside), self.features, self.y, self.config, _scale(found[f"q_{name}"]), f"{name}_pred", own)
        self.models = in_parallel(df.sparkSession, jobs)
        drop_tables(df.sparkSession, paths)
        return self

    def fit_one(self, df: DataFrame) -> "TwoRegime":
        """In place of `fit` where it raises `TooFewRows`: one regressor of all rows.

        The low regime has probability 0 and the same forecast, and the gate is shut.
        """
        self.models = {"normal": fit_trees(df, self.features, self.y, self.config, out="normal_pred")}
        self.threshold, self.ramp = 1.1, 0.0
        return self

    def fit_calibrated(self, df: DataFrame, calibration_days: int = 365, min_counts=(512, 96, 100, 20)) -> "TwoRegime":
        """Choose the gate threshold on the last ``calibration_days``, then refit on everything.

        ``min_counts``: development rows, calibration rows, low rows in each; below them
        the gate stays off.
        """
        last = df.agg(F.date_sub(F.max("date"), calibration_days).alias("d")).first()["d"]
        cut = F.col("date") >= F.lit(last)
        low = is_low(self.y, self.limits)
        c = df.agg(
            F.count_if(~cut).alias("dev"), F.count_if(cut).alias("cal"),
            F.count_if(~cut & low).alias("dev_low"), F.count_if(cut & low).alias("cal_low"),
        ).first()
        enough = min(c["dev"] - c["dev_low"], c["dev_low"]) >= self.min_rows
        if enough and all(have >= need for have, need in zip(c, min_counts)):
            probe = replace(self, models=None).fit(df.where(~cut))
            scored = probe.transform(df.where(cut)).withColumn("series_id", F.lit("all"))
            sweep = tuning.threshold_sweep(scored, low, "prob")
            self.threshold = tuning.best_threshold(sweep).first()["threshold"]
        return self.fit(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prob``, ``low_pred``, with a normal regressor ``normal_pred`` and ``mixture``, and ``weight``."""
        out = score_all(self.models, df)
        if "classifier" in self.models:
            out = out.withColumn("prob", vector_to_array("__probs")[1]).drop("__probs", "__raw", "__called")
        else:
            out = out.withColumns({"prob": F.lit(0.0), "low_pred": F.col("normal_pred")})
        if self.fit_normal:
            out = out.withColumn("mixture", soft_mixture("prob", "normal_pred", "low_pred"))
        return out.withColumn("weight", gate_weight("prob", self.threshold, self.ramp))

    def blend(self, df: DataFrame, base: str, out: str) -> DataFrame:
        """``base`` gated towards the low forecast; ``df`` carries this model's columns."""
        return df.withColumn(out, gate_blend(base, "low_pred", "weight", self.limits))

    def save(self, path: str, spark: SparkSession) -> None:
        for name, m in self.models.items():
            m.write().overwrite().save(f"{path}/{name}")
        gate = [(self.threshold, self.ramp, list(self.models))]
        save_table(spark.createDataFrame(gate, "threshold double, ramp double, models array<string>"), f"{path}/gate")

    def load(self, path: str, spark: SparkSession) -> "TwoRegime":
        gate = load_table(spark, f"{path}/gate", {"threshold", "ramp"}).first().asDict()
        names = gate.get("models") or ["classifier", "low"] + (["normal"] if self.fit_normal else [])
        models = {n: PipelineModel.load(f"{path}/{n}") for n in names}
        return replace(self, models=models, threshold=gate["threshold"], ramp=gate["ramp"])


def best_iteration(history: DataFrame, low: int = 100, high: int = 800) -> DataFrame:
    """Per model: median of the folds' iteration counts, clipped."""
    mid = F.floor(F.median("iterations"))
    return history.groupBy("model").agg(F.greatest(F.least(mid, F.lit(high)), F.lit(low)).cast("int").alias("iterations"))


def importance(model: PipelineModel, features: list[str], spark: SparkSession, top: int = 20) -> DataFrame:
    """The ``top`` features by importance, highest first."""
    values = trees_of(model).featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)
