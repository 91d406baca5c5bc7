"""Sinks. All go through ``df.write``, so a large result is written by its tasks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.numeric import as_col
from slotcast.functions.regime import is_low
from slotcast.limits import Limits


def write_predictions(df: DataFrame, path: str, actual: str = "y", pred: str = "pred", fmt: str = "parquet") -> None:
    """``series_id, ts, actual, predicted``, partitioned by year so a reader can prune."""
    out = df.select("series_id", "ts", F.col(actual).alias("actual"), F.col(pred).alias("predicted"), F.year("ts").alias("year"))
    _write(out, path, fmt, ["year"])


def regime_events(df: DataFrame, actual: str = "y", pred: str = "pred", prob: str = "prob", weight: str = "weight", limits: Limits = Limits()) -> DataFrame:
    """Actual and called low-regime events; called means a gate weight of at least one half."""
    return df.select(
        "series_id", "ts", F.col(actual).alias("actual"), F.col(pred).alias("predicted"),
        F.col(prob).alias("low_probability"), F.col(weight).alias("low_weight"),
        is_low(actual, limits).cast("int").alias("actual_low"),
        (as_col(weight) >= 0.5).cast("int").alias("predicted_low"),
    )


def write_regime_events(df: DataFrame, path: str, fmt: str = "parquet", **kw) -> None:
    _write(regime_events(df, **kw).withColumn("year", F.year("ts")), path, fmt, ["year"])


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A metrics table: overall, by slot, by month or of a sweep."""
    _write(df, path, fmt, [])


def write_manifest(rows: DataFrame, path: str) -> None:
    """Settings and scores as JSON lines, nested values kept; missing numbers stay missing."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _write(df: DataFrame, path: str, fmt: str, by: list[str]) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def save_table(df: DataFrame, path: str) -> None:
    """A small state table: slot bias, bounds, thresholds."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, columns: set[str]) -> DataFrame:
    """Read a state table back; raise when it is not the expected kind."""
    df = spark.read.parquet(path)
    if not columns <= set(df.columns):
        raise TypeError(f"{path} lacks {sorted(columns - set(df.columns))}")
    return df
