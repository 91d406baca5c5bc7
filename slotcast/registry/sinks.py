"""Sinks and sources: what is written is read back."""

from pyspark.sql import functions as F

from slotcast.functions.regime import gate_weight
from slotcast.operators import metrics, panel
from slotcast.plans.evaluate import evaluate, manifest_row
from slotcast.registry.base import (
    GATED, LIMITS, ROWS, big, cents, errors_sql, event_rows, gated_rows, num, nums, query, read, text, with_ctes,
)
from slotcast.sources import readers, writers
from slotcast.sources.shared import new_path

L = LIMITS


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {text('ts')}, {num('y', 'actual')}, {num('normal', 'predicted')}, {num('prob', 'low_probability')},
    {num('w', 'low_weight')}, {big(f'y <= {L.low}', 'actual_low')}, {big('w >= 0.5', 'predicted_low')}
    FROM (SELECT *, greatest(least((prob - 0.3) / 0.2, 1), 0) AS w FROM gated)"""))
def regime_events(spark, sf_dir):
    """Actual and called low-regime events, written as parquet and read back."""
    path = f"{new_path(spark)}/events"
    df = gated_rows(spark, sf_dir).withColumns({"w": gate_weight("prob", 0.4, 0.1)})
    writers.write_regime_events(df, path, actual="y", pred="normal", prob="prob", weight="w", limits=L)
    return spark.read.parquet(path).drop("year")


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('ts')}, {num('y', 'actual')}, {num('b_1d', 'predicted')} FROM rows"))
def predictions_sink(spark, sf_dir):
    """Predictions written by year as CSV and read back with a schema."""
    path = f"{new_path(spark)}/predictions"
    writers.write_predictions(event_rows(spark, sf_dir), path, "y", "b_1d", "csv")
    schema = "series_id string, ts timestamp_ntz, actual double, predicted double, year int"
    return spark.read.schema(schema).csv(path, header=True).drop("year")


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {errors_sql(p='least(b_1d, 180.0)')}, {big('false', 'target_met')}, {num('7', 'bias_days')} FROM rows GROUP BY 1"))
def metrics_manifest(spark, sf_dir):
    """Metrics and nested settings as JSON, read back."""
    path = f"{new_path(spark)}/manifest"
    rows = event_rows(spark, sf_dir).withColumn("p", F.least("b_1d", F.lit(180.0)))
    m = metrics.with_target_met(metrics.metrics(rows, ["series_id"], "y", "p", limits=L), 1.0, 1.0)
    full = manifest_row(m, bias_days=7.0)
    writers.write_manifest(full, path)
    back = spark.read.schema(full.schema).json(path)
    return back.select(*m.columns, F.col("settings.bias_days").alias("bias_days"))


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {big('cycle', 'cycle')}, {big('count(*)', 'samples')}, {num('avg(abs(y - b_1d))', 'mae')} FROM rows GROUP BY 1, cycle"""))
def evaluation_by_slot(spark, sf_dir):
    """The evaluation run with all its sinks; the table by slot read back from CSV."""
    path = f"{new_path(spark)}/evaluation"
    rows = event_rows(spark, sf_dir)
    wide = L.__class__(low=L.low, high=L.high, floor=-1e9, ceiling=1e9)
    evaluate(rows, "y", "b_1d", lag="b_7d", out=path, limits=wide)
    schema = evaluate(rows, "y", "b_1d", limits=wide)["by_cycle"].schema
    return spark.read.schema(schema).csv(f"{path}/metrics_by_cycle", header=True).select("series_id", "cycle", "samples", "mae")


@query(lambda: with_ctes(("bucket",), f"""SELECT series_id, {text('ts')}, {nums('y', 'load')} FROM bucket"""))
def csv_series(spark, sf_dir):
    """Half-hourly values of many series, some files with other column orders and a repeated row per time, read in one go without the repeats."""
    path = new_path(spark)
    ev = read(spark, sf_dir, "events")
    slots = panel.to_slots(ev, "event_type", "ts", y=cents("value"), load=F.count("*").cast("double"))
    rows = slots.select(F.col("ts").cast("string").alias("datetime"), F.col("y").cast("double").alias("y"), "load", "series_id")
    rows.write.partitionBy("series_id").option("header", True).csv(f"{path}/a")
    repeats = rows.select("load", F.lit("x").alias("other"), (F.col("y") + 1000).alias("y"), "datetime", "series_id")
    repeats.write.partitionBy("series_id").option("header", True).csv(f"{path}/b")
    name = F.regexp_extract("_file", "series_id=([^/]+)", 1)
    return readers.read_series(spark, f"{path}/*/*", ["y", "load"], name)


@query(lambda: f"""SELECT {text('ts')}, {nums('q', 'p', 'd')} FROM (SELECT l_shipdate AS ts, avg(q) AS q, avg(p) AS p, avg(d) AS d FROM (
    SELECT l_returnflag, l_shipdate, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def csv_files_rollup(spark, sf_dir):
    """Plants in files of different column orders, read by name and rolled up per plant, then over plants."""
    path = new_path(spark)
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("string").alias("datetime"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), "l_returnflag"
    )
    for flag, order in (("A", ["datetime", "q", "p", "d"]), ("N", ["d", "datetime", "p", "q"]), ("R", ["p", "q", "d", "datetime"])):
        part = li.where(F.col("l_returnflag") == flag).select(*order, "l_returnflag")
        part.write.mode("append").partitionBy("l_returnflag").option("header", True).csv(f"{path}/files")
    # one writer may cut a source into several files, so the source is the folder
    source = F.regexp_extract("_file", "l_returnflag=([^/]+)", 1)
    out = readers.hydro_rollup(spark, f"{path}/files/*", source, ["q", "p"], ["d"])
    return out.select("ts", *[F.col(c).alias(c.removeprefix("hydro_")) for c in out.columns if c != "ts"])
