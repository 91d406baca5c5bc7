"""The stacked model: out-of-fold base forecasts, a blend, and rules tuned on the newest fifth of them.

Tree learners are pooled over series. The blend, the slot bias, the gate, the step
bounds and the state projection are tables with one entry per series, so each series
is tuned on its own rows without a loop over series.
"""

import json
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.regime import gate_blend, gate_weight, is_clean, project_states
from slotcast.limits import Limits
from slotcast.operators import blend, shape, similar, tuning
from slotcast.operators.models import REFIT, STACK_TREES, TooFewRows, TreeConfig, TwoRegime, best_iteration, day_folds, fit_folds, fit_trees, in_parallel, score_all, trees_of
from slotcast.operators.slotlinear import SlotLinear, fit_panel, predict_panel
from slotcast.sources.shared import settle
from slotcast.sources.writers import load_table, save_table

SHOWN = 1000
STATES = {
    "coef": ("coef", "candidate"), "bias": ("cycle", "slot_bias"), "gate": ("threshold", "ramp"),
    "bounds": ("normal_lo", "gate_hi"), "guard": ("guard_on",),
    "projection": ("lower_cut", "cap_cut", "lower_value", "cap_value"),
}


@dataclass
class Stack:
    """Base learners, blend and shape rules.

    No row is lost: a series or day without a blend, as a learner had too few days for it, has
    the mean of the tree forecasts instead, and rules without a state leave it as it is. Where one of the regimes
    has too few rows there is no regime model: ``prob`` and ``low_pred`` are missing, and without rows that have them
    the gate is not tuned and stays shut.

    ``candidates`` maps a name to the base forecasts it blends; the set with the lowest
    clean error on the newest rows is used, per series.
    """

    features: list[str]
    profile: list[str]
    scalar: list[str] = field(default_factory=list)
    y: str = "y"
    trees: dict[str, TreeConfig] = field(default_factory=lambda: dict(STACK_TREES))
    regime_config: TreeConfig = TreeConfig(depth=6, half_life_days=730.0, refit=REFIT)
    n_folds: int = 5
    neighbours: int = similar.NEIGHBOURS
    selection_share: float = 0.8
    linear: dict = field(default_factory=dict)
    limits: Limits = Limits()
    thresholds: tuple = tuning.GATE_THRESHOLDS
    ramps: tuple = tuning.GATE_RAMPS
    lower_cuts: tuple = tuning.LOWER_CUTS
    cap_cuts: tuple = tuning.CAP_CUTS
    levels: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    min_regime_rows: int = 100
    iterations: tuple = (100, 800)
    models: dict[str, PipelineModel] = field(default_factory=dict)
    regime: TwoRegime | None = None
    slot_linear: SlotLinear | None = None
    train: DataFrame | None = None
    history: list = field(default_factory=list)
    states: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def base(self) -> list[str]:
        return [*self.trees, "slot_linear", "similar_day"]

    @property
    def candidates(self) -> dict[str, list[str]]:
        names = list(self.trees)
        return {"trees": names, "trees_linear": [*names, "slot_linear"], "trees_similar": [*names, "similar_day"]}

    def _new_regime(self) -> TwoRegime:
        return TwoRegime(self.features, self.y, self.regime_config, True, self.min_regime_rows, self.limits)

    def _components(self, train: DataFrame, df: DataFrame, models, regime, linear) -> DataFrame:
        """Every base forecast of ``df`` as a column; ``train`` holds the days to compare with."""
        out = score_all(models, df)
        if regime is None:
            out = out.withColumns(dict.fromkeys(("prob", "low_pred"), F.lit(None).cast("double")))
        else:
            out = regime.transform(out).drop("weight", "mixture")
        out = predict_panel(linear, out, self.profile, self.scalar, "slot_linear")
        near = similar.similar_days(train, df, self.profile, self.scalar, self.y, self.neighbours)
        return out.join(near.withColumnRenamed("pred", "similar_day"), ["series_id", "date", "cycle"], "left")

    def out_of_fold(self, folded: DataFrame) -> DataFrame:
        """Base forecasts of every validation fold from learners that saw only earlier folds."""
        spark, folds = folded.sparkSession, range(1, self.n_folds + 1)
        models = fit_folds(folded, self.features, self.trees, self.y, held=True)
        self.history = [(n, len(trees_of(m).trees)) for (_, n), m in models.items()]
        regimes = in_parallel(spark, {f"regime {k}": partial(self._fold_regime, folded, k) for k in folds}, 2)
        parts = []
        for k in folds:
            train, test = folded.where(F.col("fold") < k), folded.where(F.col("fold") == k)
            linear = fit_panel(train, self.profile, self.scalar, self.y, **self.linear)
            parts.append(self._components(train, test, {n: models[k, n] for n in self.trees}, regimes[f"regime {k}"], linear))
        kept = ["series_id", "ts", "date", "cycle", "fold", self.y, *self.base, "prob", "low_pred"]
        return reduce(DataFrame.unionByName, [p.select(*kept) for p in parts])

    def _fit_regime(self, df: DataFrame, validation: str | None = None) -> TwoRegime | None:
        """The regime model, if both regimes have enough rows."""
        try:
            return self._new_regime().fit(df, validation)
        except TooFewRows:
            return None

    def _fold_regime(self, folded: DataFrame, k: int) -> TwoRegime | None:
        """The regime model of earlier folds, stopped early by fold ``k``."""
        held = folded.where(F.col("fold") <= k).withColumn("__held", F.col("fold") == k)
        return self._fit_regime(held, "__held")

    def _coefs(self, rows: DataFrame) -> DataFrame:
        """Per series and candidate: weights over all base forecasts, 0 for those not in it.

        A candidate is fitted on the rows that have all its forecasts, under folds of their own.
        """
        out = []
        for name, models in self.candidates.items():
            whole = blend.fresh_folds(rows.dropna(subset=[self.y, *models]), self.n_folds)
            fitted = blend.ridge_blend(whole, models, self.y)
            weights = [F.col("coef")[models.index(m) + 1] if m in models else F.lit(0.0) for m in self.base]
            full = F.array(F.col("coef")[0], *weights)
            out.append(fitted.select("series_id", F.lit(name).alias("candidate"), "alpha", full.alias("coef")))
        return reduce(DataFrame.unionByName, out)

    def fit(self, df: DataFrame) -> "Stack":
        """``df`` has target and features on every row."""
        used = dict.fromkeys(["series_id", "ts", "date", "cycle", self.y, *self.features, *self.profile, *self.scalar])
        self.train = settle(day_folds(df.select(*used), self.n_folds), "stack-train")
        oof = settle(self.out_of_fold(self.train), "stack-oof")
        self._tune(oof)
        history = df.sparkSession.createDataFrame(self.history, "model string, iterations int")
        best = {r["model"]: r["iterations"] for r in best_iteration(history, *self.iterations).collect()}
        final = {n: replace(c, trees=best[n]) for n, c in self.trees.items()}
        spark = df.sparkSession
        self.models = in_parallel(spark, {n: partial(fit_trees, self.train, self.features, self.y, c, out=n) for n, c in final.items()})
        self.slot_linear = fit_panel(self.train, self.profile, self.scalar, self.y, **self.linear)
        self.regime = self._fit_regime(self.train)
        return self

    def _tune(self, oof: DataFrame) -> None:
        span = oof.groupBy("series_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
        cut = F.date_add("a", F.floor((F.datediff("b", "a") + 1) * self.selection_share).cast("int"))
        placed = oof.join(span.select("series_id", cut.alias("__cut")), "series_id")
        clean = is_clean(self.y, self.limits)
        early = placed.where((F.col("date") < F.col("__cut")) & clean)
        newest = placed.where(F.col("date") >= F.col("__cut")).drop("__cut")

        tried = blend.apply_blend(newest.join(self._coefs(early), "series_id"), "coef", self.base, "pred")
        tried = settle(tried.drop("coef", "alpha"), "stack-tried")
        score = F.avg(F.when(clean, F.abs(F.col(self.y) - F.col("pred"))))
        # a set that lacks forecasts of some newest rows comes after those that have all
        missing = F.count_if(F.col("pred").isNull())
        scores = tried.groupBy("series_id", "candidate").agg(missing.alias("missing"), score.alias("score")).where("score IS NOT NULL")
        best = settle(scores.groupBy("series_id").agg(F.min_by("candidate", F.struct("missing", "score", "candidate")).alias("candidate")))
        final = self._coefs(oof.where(clean)).join(best, ["series_id", "candidate"])
        validation = self._filled(tried.join(best, ["series_id", "candidate"]))

        s = {"coef": settle(final, "stack-coef"), "bias": settle(shape.slot_bias(validation, self.y, limits=self.limits), "stack-bias")}
        normal = shape.apply_slot_bias(validation, s["bias"]).withColumnRenamed("pred", "normal")
        grid = tuning.gate_grid(normal, self.y, "normal", "low_pred", "prob", self.thresholds, self.ramps, self.limits)
        s["gate"] = settle(tuning.best_gate(grid), "stack-gate")
        s["bounds"] = settle(shape.step_bounds(self.train, self.y, limits=self.limits, **self.bounds), "stack-bounds")
        gated = self._gate(normal, s["gate"])
        guarded = settle(shape.step_guard(gated, s["bounds"]), "stack-guarded")
        s["guard"] = settle(shape.guard_helps(guarded, self.y, limits=self.limits).select("series_id", "guard_on"), "stack-guard")
        held = self._choose_guard(guarded, s["guard"])
        levels = tuning.state_levels(self.train, self.y, **self.levels)
        pairs = tuning.projection_grid(
            held, levels, self.y, "pred", "weight", self.lower_cuts, self.cap_cuts, limits=self.limits
        )
        best_pairs = tuning.best_projection(pairs).select("series_id", "lower_cut", "cap_cut")
        s["projection"] = settle(best_pairs.join(levels.select("series_id", "lower_value", "cap_value"), "series_id"), "stack-projection")
        self.states = s

    def _filled(self, df: DataFrame) -> DataFrame:
        """``pred`` of rows without a blend: the mean of the tree forecasts, which every row has."""
        trees = sum((F.col(n) for n in self.trees), F.lit(0.0)) / len(self.trees)
        return df.withColumn("pred", F.coalesce("pred", trees))

    def _gate(self, df: DataFrame, gate: DataFrame) -> DataFrame:
        """``weight`` and the gated ``pred`` from ``normal``."""
        weight = gate_weight("prob", F.col("threshold"), F.col("ramp"))
        j = df.join(gate, "series_id", "left").withColumn("weight", F.coalesce(weight, F.lit(0.0)))
        blended = F.when(F.col("weight") > 0, gate_blend("normal", "low_pred", "weight", self.limits)).otherwise(F.col("normal"))
        return j.withColumn("pred", blended).drop("threshold", "ramp")

    @staticmethod
    def _choose_guard(df: DataFrame, guard: DataFrame) -> DataFrame:
        j = df.join(guard, "series_id", "left")
        return j.withColumn("pred", F.when(F.col("guard_on"), F.col("guarded")).otherwise(F.col("pred"))).drop("guard_on", "guarded")

    def transform(self, df: DataFrame) -> DataFrame:
        """Base forecasts, blend, slot bias, gate, guard and projection; ``pred`` is the result."""
        s = self.states
        parts = self._components(self.train, df, self.models, self.regime, self.slot_linear)
        blended = parts.join(s["coef"].select("series_id", "coef"), "series_id", "left")
        mixed = self._filled(blend.apply_blend(blended, "coef", self.base, "pred"))
        normal = shape.apply_slot_bias(mixed.drop("coef"), s["bias"]).withColumnRenamed("pred", "normal")
        keep = [c for c in normal.columns if c in ("series_id", "ts", "date", "cycle", self.y, "prob", "low_pred", "normal", *self.base)]
        gated = self._gate(normal.select(*keep), s["gate"])
        held = self._choose_guard(shape.step_guard(gated, s["bounds"]), s["guard"])
        j = held.join(s["projection"], "series_id", "left")
        states = project_states("pred", "weight", *[F.col(c) for c in ("lower_cut", "cap_cut", "lower_value", "cap_value")])
        return j.withColumn("pred", states).drop("lower_cut", "cap_cut", "lower_value", "cap_value")

    def settings(self) -> dict:
        """Everything but the fitted parts, as plain values."""
        plain = ("features", "profile", "scalar", "y", "n_folds", "neighbours", "selection_share", "linear", "levels", "bounds", "min_regime_rows")
        pairs = ("thresholds", "ramps", "lower_cuts", "cap_cuts", "iterations")
        return {k: getattr(self, k) for k in plain} | {k: list(getattr(self, k)) for k in pairs} | {
            "trees": {n: asdict(c) for n, c in self.trees.items()}, "regime_config": asdict(self.regime_config), "limits": asdict(self.limits),
            "has_regime": self.regime is not None,
        }

    def tuned(self) -> dict:
        """What the fit chose, by table; the weights, gates, cuts and guards of at most ``SHOWN`` series."""
        shown = {n: [r.asDict() for r in t.orderBy("series_id").limit(SHOWN).collect()] for n, t in self.states.items() if n not in ("bias", "bounds")}
        return shown | {"iterations": {n: len(trees_of(m).trees) for n, m in self.models.items()}, "threshold": self.regime and self.regime.threshold}

    def save(self, path: str, spark: SparkSession) -> None:
        """Learners as Spark ML directories, everything tuned as tables, the settings last."""
        for n, m in self.models.items():
            m.write().overwrite().save(f"{path}/trees/{n}")
        if self.regime is not None:
            self.regime.save(f"{path}/regime", spark)
        save_table(self.slot_linear.model, f"{path}/linear")
        save_table(self.train, f"{path}/train")
        for n, t in self.states.items():
            save_table(t, f"{path}/state/{n}")
        save_table(spark.createDataFrame([(json.dumps(self.settings()),)], "settings string"), f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Stack":
        """Read what ``save`` wrote, settings included; ``TypeError`` for anything else."""
        s = json.loads(load_table(spark, f"{path}/settings", {"settings"}).first()["settings"])
        for k in ("thresholds", "ramps", "lower_cuts", "cap_cuts", "iterations"):
            s[k] = tuple(s[k])
        s |= {"trees": {n: TreeConfig(**c) for n, c in s["trees"].items()}, "regime_config": TreeConfig(**s["regime_config"]), "limits": Limits(**s["limits"])}
        regime = s.pop("has_regime", True)
        out = cls(**s)
        out.linear = {k: tuple(v) if isinstance(v, list) else v for k, v in out.linear.items()}
        out.states = {n: load_table(spark, f"{path}/state/{n}", {"series_id", *cols}) for n, cols in STATES.items()}
        out.models = {n: PipelineModel.load(f"{path}/trees/{n}") for n in out.trees}
        out.regime = out._new_regime().load(f"{path}/regime", spark) if regime else None
        out.slot_linear = SlotLinear(model=load_table(spark, f"{path}/linear", {"coef", "intercept"}))
        out.train = load_table(spark, f"{path}/train", {"series_id", "ts", out.y})
        return out
