"""The production model: trailing-window trees, an optional daily linear model and a regime gate."""

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.numeric import dot, row_median
from slotcast.limits import Limits
from slotcast.operators import calibrate
from slotcast.operators.models import REFIT, TooFewRows, TreeConfig, TwoRegime, WINDOW_DAYS, fit_windows, score_all, trees_of
from slotcast.operators.slotlinear import SlotLinear, fit_panel, predict_panel
from slotcast.sources.shared import settle
from slotcast.sources.writers import load_table, save_table

GATED = "gated_"


@dataclass
class Adaptive:
    """One chosen candidate, fitted on all history and served with its corrections.

    ``candidate`` is ``trees_<n>d``, ``adaptive_median``, ``online_average``,
    ``slot_linear`` or ``hybrid_median``, with ``gated_`` in front to apply the gate.
    """

    features: list[str]
    candidate: str = "adaptive_median"
    profile: list[str] = field(default_factory=list)
    scalar: list[str] = field(default_factory=list)
    windows: tuple = WINDOW_DAYS
    bias_days: int = 0
    cap_days: int = 0
    cap_ratio: float | None = None
    y: str = "y"
    reveal_lag_days: int = 2
    online_days: int = 28
    config: TreeConfig = TreeConfig(refit=REFIT)
    linear: dict = field(default_factory=dict)
    limits: Limits = Limits()
    trees: dict[str, PipelineModel] = field(default_factory=dict)
    slot_linear: SlotLinear | None = None
    regime: TwoRegime | None = None

    @property
    def inputs(self) -> list[str]:
        """Every feature column a forecast reads."""
        return list(dict.fromkeys([*self.features, *self.profile, *self.scalar]))

    @property
    def gated(self) -> bool:
        return self.candidate.startswith(GATED)

    @property
    def base(self) -> str:
        return self.candidate.removeprefix(GATED)

    def fit(self, df: DataFrame, regime: TwoRegime | None = None, min_rows: int = 256) -> "Adaptive":
        """Fit every part on rows that have target and features; a regime with too few rows is left out.

        The rows are written once and every fit reads the columns it needs from there.
        """
        used = dict.fromkeys(["series_id", "ts", "date", "cycle", self.y, *self.features, *self.profile, *self.scalar])
        df = settle(df.select(*used), "train")
        start = df.agg((F.max("ts") + F.expr("interval 30 minutes")).alias("t")).first()["t"]
        self.trees = fit_windows(df, self.features, start, self.windows, self.y, self.config, min_rows, self.limits)
        if not self.trees:
            raise ValueError("no trailing window has enough clean rows")
        if self.base in ("slot_linear", "hybrid_median"):
            self.slot_linear = fit_panel(df, self.profile, self.scalar, self.y, **self.linear)
        regime = regime or TwoRegime(self.features, self.y, fit_normal=False, limits=self.limits)
        try:
            self.regime = regime.fit_calibrated(df)
        except TooFewRows:
            self.regime = None
        return self

    def components(self, df: DataFrame) -> DataFrame:
        """All model outputs as columns."""
        out = score_all(self.trees, df)
        if self.slot_linear is not None:
            out = predict_panel(self.slot_linear, out, self.profile, self.scalar, "slot_linear")
        return self.regime.transform(out) if self.regime is not None else out

    def with_base(self, scored: DataFrame) -> DataFrame:
        """``base``: the candidate's own forecast, before any correction; the trees' median where it has none."""
        staged = scored.withColumn("__m", row_median(list(self.trees)))
        forecasts = {n: F.col(n) for n in [*self.trees, "slot_linear"] if n in scored.columns}
        forecasts |= dict.fromkeys(("adaptive_median", "online_average"), F.col("__m"))
        if "slot_linear" in scored.columns:
            forecasts["hybrid_median"] = row_median(["__m", "slot_linear"])
        if self.base not in forecasts:
            raise ValueError(f"unknown candidate {self.candidate}")
        return staged.withColumn("base", F.coalesce(forecasts[self.base], "__m")).drop("__m")

    def gate(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if not self.gated or self.regime is None:
            return df.withColumn(out, F.col(col))
        return self.regime.blend(df, col, out)

    def transform(self, df: DataFrame) -> DataFrame:
        """Row forecasts without history."""
        return self.gate(self.with_base(self.components(df)), "base", "pred")

    def _corrections(self) -> dict:
        return {"bias_days": self.bias_days, "cap_days": self.cap_days, "cap_ratio": self.cap_ratio}

    def walk_forward(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Forecasts of a past stretch, each day corrected from the days before it."""
        scored = self.components(df)
        if self.base == "online_average":
            base = calibrate.trailing_blend(
                scored, list(self.trees), "base", y=self.y, lookback_days=self.online_days,
                reveal_lag_days=self.reveal_lag_days, limits=self.limits,
            )
        else:
            base = self.with_base(scored)
        adjusted = calibrate.walk_forward_adjust(
            base, history, self.y, reveal_lag_days=self.reveal_lag_days, limits=self.limits, **self._corrections()
        )
        return self.gate(adjusted, "adjusted", "pred")

    def day_ahead(self, target: DataFrame, history: DataFrame) -> DataFrame:
        """One whole day per series, corrected from its recent history."""
        t, h = self.components(target), self.components(history)
        if self.base == "online_average":
            names = list(self.trees)
            day = target.groupBy("series_id").agg(F.min("date").alias("__day"))
            recent = h.join(day, "series_id").where(
                (F.col("date") < F.col("__day")) & (F.col("date") >= F.date_sub("__day", self.online_days))
            )
            weights = calibrate.component_weights(recent, names, self.y, self.limits)
            cols = [f"w_{n}" for n in names]
            equal = F.lit(1.0 / len(names))
            t, h = (
                x.join(weights, "series_id", "left")
                .withColumn("base", dot(names, [F.coalesce(c, equal) for c in cols])).drop(*cols)
                for x in (t, h)
            )
        else:
            t, h = self.with_base(t), self.with_base(h)
        if self.gated and self.regime is not None:
            h = self.regime.blend(h, "base", "base")
        adjusted = calibrate.single_day_adjust(
            t, h.select("series_id", "ts", "date", F.col(self.y).alias("y"), "base"), limits=self.limits, **self._corrections()
        )
        return self.gate(adjusted, "adjusted", "pred")

    def settings(self) -> dict:
        """Everything but the fitted parts, as plain values."""
        plain = ("features", "candidate", "profile", "scalar", "bias_days", "cap_days", "cap_ratio", "y", "reveal_lag_days", "online_days", "linear")
        return {k: getattr(self, k) for k in plain} | {
            "windows": list(self.windows), "config": asdict(self.config), "limits": asdict(self.limits), "trees": list(self.trees),
            "has_linear": self.slot_linear is not None, "has_regime": self.regime is not None,
            "regime_features": self.regime.features if self.regime else [], "regime_config": asdict(self.regime.config) if self.regime else {},
        }

    def tuned(self) -> dict:
        """What the fit chose."""
        return {
            "iterations": {n: len(trees_of(m).trees) for n, m in self.trees.items()},
            "threshold": self.regime.threshold if self.regime else None, "ramp": self.regime.ramp if self.regime else None,
        }

    def save(self, path: str, spark: SparkSession) -> None:
        """Models as Spark ML directories, all settings and the linear weights as tables."""
        for name, m in self.trees.items():
            m.write().overwrite().save(f"{path}/trees/{name}")
        save_table(spark.createDataFrame([(json.dumps(self.settings()),)], "settings string"), f"{path}/settings")
        if self.slot_linear is not None:
            save_table(self.slot_linear.model, f"{path}/linear")
        if self.regime is not None:
            self.regime.save(f"{path}/regime", spark)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Adaptive":
        """Read a saved model with its settings; raise ``TypeError`` when the directory holds something else."""
        s = json.loads(load_table(spark, f"{path}/settings", {"settings"}).first()["settings"])
        names, linear, regime = s.pop("trees"), s.pop("has_linear"), s.pop("has_regime")
        regime_features, regime_config = s.pop("regime_features"), s.pop("regime_config")
        s |= {"windows": tuple(s["windows"]), "config": TreeConfig(**s["config"]), "limits": Limits(**s["limits"])}
        out = cls(**s)
        out.trees = {n: PipelineModel.load(f"{path}/trees/{n}") for n in names}
        if linear:
            out.slot_linear = SlotLinear(model=load_table(spark, f"{path}/linear", {"coef", "intercept"}))
        if regime:
            blank = TwoRegime(regime_features, out.y, TreeConfig(**regime_config), fit_normal=False, limits=out.limits)
            out.regime = blank.load(f"{path}/regime", spark)
        return out


def train_adaptive(df: DataFrame, features: list[str], chosen, **kw) -> Adaptive:
    """Fit the candidate a pretest chose (one row of its summary)."""
    model = Adaptive(
        features, chosen["base_candidate"], bias_days=chosen["bias_days"], cap_days=chosen["cap_days"],
        cap_ratio=chosen["cap_ratio"], **kw,
    )
    return model.fit(df)


CHOICE = ("base_candidate", "bias_days", "cap_days", "cap_ratio")


def train_by_choice(df: DataFrame, features: list[str], summary: DataFrame, **kw) -> list[tuple[DataFrame, Adaptive]]:
    """One model per distinct choice of a pretest's summary, with the series it is for and trained on.

    The distinct choices are bounded by candidates times configurations, whatever the number of series.
    """
    out = []
    for chosen in summary.select(*CHOICE).distinct().orderBy(*CHOICE).collect():
        same = [F.col(c).eqNullSafe(F.lit(chosen[c])) for c in CHOICE]
        members = summary.where(same[0] & same[1] & same[2] & same[3]).select("series_id")
        out.append((members, train_adaptive(df.join(members, "series_id", "left_semi"), features, chosen, **kw)))
    return out
