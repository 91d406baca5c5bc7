"""Pretest: every base forecast under every correction, scored per year, and the choice made from it."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.naming import candidate_name, parse_candidate
from slotcast.functions.numeric import row_median
from slotcast.functions.regime import cap_snap, publishable
from slotcast.limits import SLOTS, Limits
from slotcast.operators import calibrate, metrics
from slotcast.operators.models import REFIT, TooFewRows, TreeConfig, TwoRegime, WINDOW_DAYS, fit_windows, score_all
from slotcast.operators.policy import training_rows
from slotcast.operators.slotlinear import fit_panel, predict_panel
from slotcast.sources.shared import settle

# fixed values: (bias days, cap days, cap ratio)
CONFIGS = (
    (0, 0, None), (7, 28, 0.95), (14, 14, 0.95), (14, 28, 0.90),
    (14, 28, 0.95), (14, 28, 0.98), (14, 56, 0.95), (28, 28, 0.95),
)
PRETEST_YEARS = (2024, 2025)
FIRST_YEAR = 2021
TEST_YEAR = 2026
ONLINE_DAYS = 28


def guard_years(years, test_year: int = TEST_YEAR) -> tuple[int, ...]:
    """Pretest years must all lie before the test year."""
    years = tuple(int(y) for y in years)
    if not years or max(years) >= test_year:
        raise ValueError(f"only years before {test_year} may be used, got {years}")
    return years


def sweep(
    df: DataFrame,
    candidates: list[str],
    configs=CONFIGS,
    history: DataFrame | None = None,
    y: str = "y",
    reveal_lag_days: int = 2,
    min_bias_days: int = 3,
    min_cap_rows: int = SLOTS,
    quantile: float = 0.98,
    limits: Limits = Limits(),
) -> DataFrame:
    """``series_id, year, candidate`` and metrics for every candidate column and configuration.

    Residual medians, trailing biases and caps are made once per day for all
    configurations; a year starts without bias history, the cap also sees earlier
    years. The panel is then read once: each row unfolds into its corrected forecasts,
    which are aggregated before the shuffle.
    """
    df = df.withColumn("year", F.year("date"))
    bias_days = sorted({b for b, _, _ in configs if b})
    cap_days = sorted({c for _, c, r in configs if c and r is not None})
    clean = calibrate.is_clean(y, limits)
    days = df.groupBy("series_id", "year", "date").agg(
        *[F.median(F.when(clean, F.col(y) - F.col(c))).alias(f"__r_{c}") for c in candidates]
    )
    biases = {}
    for b in bias_days:
        w = Window.partitionBy("series_id", "year").orderBy("date")
        w = w.rowsBetween(-(b + reveal_lag_days - 1), -reveal_lag_days)
        for c in candidates:
            enough = F.count(f"__r_{c}").over(w) >= min_bias_days
            biases[f"__b{b}_{c}"] = F.coalesce(F.when(enough, F.expr(f"percentile(`__r_{c}`, 0.5)").over(w)), F.lit(0.0))
    days = days.withColumns(biases) if biases else days
    days = days.drop("year", *[f"__r_{c}" for c in candidates])
    if cap_days:
        actuals = df.select("series_id", "ts", "date", y)
        if history is not None:
            actuals = calibrate.merge_revealed(history.select("series_id", "ts", "date", y), actuals)
        caps = calibrate.day_values(actuals, y)
        for c in cap_days:
            caps = calibrate.trailing_cap(caps, c, quantile, reveal_lag_days, min_cap_rows, f"__c{c}")
        days = days.join(caps.drop("day_values"), ["series_id", "date"], "left")
    rows = df.where(F.col(y).isNotNull()).join(days, ["series_id", "date"], "left")
    points, names = [], []
    for c in candidates:
        for b, k, r in configs:
            p = F.col(c) + F.col(f"__b{b}_{c}") if b else F.col(c)
            p = cap_snap(p, F.col(f"__c{k}"), r) if k and r is not None else p
            names.append(candidate_name(F.lit(c), F.lit(b), F.lit(k), F.lit(r).cast("double")))
            points.append(publishable(F.when(F.col(c).isNotNull(), p), limits))
    # rows are unfolded by number; names are put on the few aggregated rows. Each candidate is scored on the rows it forecasts
    flat = rows.select("series_id", "year", y, F.posexplode(F.array(*points)).alias("point", "pred")).where("pred IS NOT NULL")
    scores = metrics.metrics(flat, ["series_id", "year", "point"], y, "pred", limits=limits)
    label = F.get(F.array(*names), F.col("point")).alias("candidate")
    return scores.select("series_id", "year", label, *[c for c in scores.columns if c not in ("series_id", "year", "point")])


def target_ratio(mae: float = metrics.TARGET_MAE, wmape: float = metrics.TARGET_WMAPE):
    """How far a row is from both accuracy targets; 1 is just met."""
    return F.greatest(F.col("clean_mae") / mae, F.col("clean_wmape") / wmape)


def scoreboard(m: DataFrame, years: int, mae: float = metrics.TARGET_MAE, wmape: float = metrics.TARGET_WMAPE) -> DataFrame:
    """Per series and candidate with all years present: worst target ratio and worst overall error."""
    per = m.withColumn("ratio", target_ratio(mae, wmape)).groupBy("series_id", "candidate").agg(
        F.count("*").alias("years"), F.max("ratio").alias("worst_ratio"), F.max("wmape").alias("worst_wmape"),
        F.min("low_recall").alias("min_low_recall"),
        F.every((F.col("clean_mae") < mae) & (F.col("clean_wmape") < wmape)).alias("target_met"),
    )
    return per.where(F.col("years") == years)


def select_candidate(board: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per series: among candidates within ``tolerance`` of the best ratio, the lowest overall error, then ratio."""
    best = board.groupBy("series_id").agg(F.min("worst_ratio").alias("__best"))
    near = board.join(best, "series_id").where(F.col("worst_ratio") <= F.col("__best") + tolerance).drop("__best")
    cols = [c for c in near.columns if c != "series_id"]
    pick = F.min_by(F.struct(*cols), F.struct("worst_wmape", "worst_ratio", "candidate"))
    chosen = near.groupBy("series_id").agg(pick.alias("p")).select("series_id", "p.*")
    return chosen.select("*", *[c.alias(n) for n, c in parse_candidate("candidate").items()])


def best_per_year(m: DataFrame, mae: float = metrics.TARGET_MAE, wmape: float = metrics.TARGET_WMAPE) -> DataFrame:
    """Per series and year: the candidate nearest to the targets."""
    staged = m.withColumn("ratio", target_ratio(mae, wmape))
    row = F.struct("candidate", "ratio", "clean_mae", "clean_wmape", "low_recall")
    best = F.min_by(row, F.struct("ratio", "candidate"))
    return staged.groupBy("series_id", "year").agg(best.alias("b")).select("series_id", "year", "b.*")


def base_predictions(
    history: DataFrame, year: DataFrame, features: list[str], start, profile: list[str], scalar: list[str] = [],
    windows=WINDOW_DAYS, y: str = "y", config: TreeConfig = TreeConfig(refit=REFIT), regime: TwoRegime | None = None,
    linear: dict | None = None, reveal_lag_days: int = 2, limits: Limits = Limits(), **kw,
) -> tuple[DataFrame, list[str]]:
    """Window models, their median and trailing blend, the daily linear model and gated variants, as columns.

    A series without a daily linear model has no forecasts of the candidates built on it, so
    they are missing from its scores and never chosen for it.
    """
    models = fit_windows(history, features, start, windows, y, config, limits=limits, **kw)
    if not models:
        raise ValueError(f"no window before {start} has enough rows")
    names = list(models)
    out = score_all(models, year).withColumn("adaptive_median", row_median(names))
    out = calibrate.trailing_blend(out, names, "online_average", y=y, reveal_lag_days=reveal_lag_days, limits=limits)
    names += ["adaptive_median", "online_average"]
    if profile:
        fitted = fit_panel(history, profile, scalar, y, **(linear or {}))
        if not fitted.model.isEmpty():
            out = predict_panel(fitted, out, profile, scalar, "slot_linear")
            out = out.withColumn("hybrid_median", F.when(F.col("slot_linear").isNotNull(), row_median(["adaptive_median", "slot_linear"])))
            names += ["slot_linear", "hybrid_median"]
    regime = regime or TwoRegime(features, y, fit_normal=False, limits=limits)
    try:
        regime = regime.fit_calibrated(history)
    except TooFewRows:
        return out, names
    out = regime.transform(out)
    gated = []
    for n in names:
        out = regime.blend(out, n, f"gated_{n}")
        gated.append(f"gated_{n}")
    return out, names + gated


def run_pretest(
    df: DataFrame, features: list[str], profile: list[str] = [], scalar: list[str] = [], years=PRETEST_YEARS,
    windows=WINDOW_DAYS, y: str = "y", configs=CONFIGS, reveal_lag_days: int = 2, limits: Limits = Limits(),
    first_year: int = FIRST_YEAR, test_year: int = TEST_YEAR, **kw,
) -> tuple[DataFrame, DataFrame]:
    """(summary, metrics): fit before each year, sweep the year, choose one candidate per series over all years."""
    years = guard_years(years, test_year)
    used = dict.fromkeys(["series_id", "ts", "date", "cycle", y, *features, *profile, *scalar])
    rows = settle(training_rows(df, features, f"{first_year}-01-01", f"{max(years) + 1}-01-01", y).select(*used), "pretest")
    parts = []
    for year in years:
        start = f"{year}-01-01"
        history = rows.where(F.col("date") < F.lit(start).cast("date"))
        end = F.lit(f"{year + 1}-01-01").cast("date")
        tested = rows.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < end))
        if tested.isEmpty():
            raise ValueError(f"{year} has no rows to score")
        preds, names = base_predictions(
            history, tested, features, start, profile, scalar, windows, y, reveal_lag_days=reveal_lag_days, limits=limits, **kw
        )
        preds = settle(preds.select("series_id", "ts", "date", "cycle", y, *names), "pretest-preds")
        parts.append(sweep(preds, names, configs, history, y, reveal_lag_days, limits=limits))
    all_years = reduce(DataFrame.unionByName, parts)
    return select_candidate(scoreboard(all_years, len(years))), all_years
