"""Score a stretch of forecasts and write every table of the evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.regime import publishable
from slotcast.limits import Limits
from slotcast.operators import metrics
from slotcast.sources import writers
from slotcast.sources.shared import settle


def evaluate(
    df: DataFrame, y: str = "y", pred: str = "pred", lag: str | None = None, weight: str | None = None,
    prob: str | None = None, manifest: DataFrame | None = None, out: str | None = None, limits: Limits = Limits(),
) -> dict[str, DataFrame]:
    """Tables ``summary``, ``by_cycle``, ``by_month``, ``predictions`` and, with a gate, ``events``.

    ``summary`` has the overall metrics, whether the target is met and, with ``lag``, the
    seasonal-naive error. With ``out`` they are written there; the forecasts, which may come from models, are
    then computed once and read back by every table.
    """
    used = dict.fromkeys(c for c in ("series_id", "ts", "date", "cycle", y, pred, lag, weight, prob) if c)
    rows = df.withColumn(pred, publishable(pred, limits)).select(*used)
    if out:
        rows = settle(rows, "forecasts")
    full = metrics.report(rows, y, pred, weight, limits)
    if out:
        full = settle(full, "metrics")
    summary = metrics.with_target_met(full.where("level = 'all'").drop("level", "cycle", "year", "month"))
    if lag:
        base = metrics.baseline(rows, lag, ["series_id"], y, limits).drop("clean_samples")
        summary = summary.join(base, "series_id", "left")
    tables = {
        "summary": summary,
        "by_cycle": full.where("level = 'cycle'").drop("level", "year", "month"),
        "by_month": full.where("level = 'month'").drop("level", "cycle"),
        "predictions": rows.select("series_id", "ts", y, pred),
    }
    if prob and weight:
        tables["events"] = writers.regime_events(rows, y, pred, prob, weight, limits)
    if out:
        writers.write_predictions(rows, f"{out}/predictions", y, pred)
        if "events" in tables:
            writers.write_regime_events(rows, f"{out}/regime_events", actual=y, pred=pred, prob=prob, weight=weight, limits=limits)
        for name in ("by_cycle", "by_month"):
            writers.write_metrics(tables[name], f"{out}/metrics_{name}")
        writers.write_metrics(summary, f"{out}/summary", "json")
        if manifest is not None:
            writers.write_manifest(manifest, f"{out}/manifest")
    return tables


def manifest_row(summary: DataFrame, **settings) -> DataFrame:
    """Settings as one nested ``settings`` column beside each summary row."""
    lits = [F.lit(v).alias(k) for k, v in settings.items()]
    return summary.withColumn("settings", F.struct(*lits)) if lits else summary
