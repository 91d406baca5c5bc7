"""Shared inputs of the registered queries, in Spark and in SQL.

Numbers are compared after rounding to 4 digits. Averages of two-decimal values often
end exactly in a 5 there, so both sides first add the same tiny offset.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast.limits import Limits
from slotcast.operators import lags, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, Callable[[], str]] = {}
OFFSET = 1e-7

# Events: thresholds in the range of ``value``. Orders: in the range of a daily mean price.
LIMITS = Limits(low=20.0, high=150.0, floor=0.0, ceiling=180.0)
DAY_LIMITS = Limits(low=150000.0, high=400000.0, floor=0.0, ceiling=450000.0)


def query(sql: Callable[[], str] | None = None):
    """Register the decorated function under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Rounded numbers, 0/1 flags, dates and times as text: types that hash alike everywhere."""
    out = []
    for f in df.schema:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"round({c} + double({OFFSET}), 4) as {c}")
        elif isinstance(f.dataType, (T.BooleanType, T.IntegerType, T.ShortType, T.ByteType)):
            out.append(f"cast({c} as bigint) as {c}")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            out.append(f"cast({c} as string) as {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def num(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + {OFFSET}, 4) AS {name}"


def nums(*cols: str) -> str:
    return ", ".join(num(c, c) for c in cols)


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def text(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS VARCHAR) AS {name or x}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str):
    """Mean of two-decimal values through whole cents: equal to the last bit in any order."""
    return F.sum(F.round(F.col(col) * 100)) / F.count(col) / 100


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly mean value and count per event type, gaps imputed."""
    return panel.build_panel(
        read(spark, sf_dir, "events"), "event_type", "ts", impute_cols=["y", "load"],
        y=cents("value"), load=F.count("*").cast("double"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows with four base forecasts: same-slot lags of 1 (origin-safe), 2, 3 and 7 days."""
    return lags.add_lags(event_panel(spark, sf_dir), {"y": "b"}, (1, 2, 3, 7)).dropna(subset=["b_7d"])


def gated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_rows`` with a low-regime probability that falls with yesterday's value."""
    return event_rows(spark, sf_dir).withColumns({
        "prob": 20.0 / (20.0 + F.col("b_1d")), "normal": F.col("b_7d"), "low_pred": F.col("b_2d"),
    })


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price per priority, with the previous and the seventh previous day row as forecasts."""
    days = read(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")
    ).agg(cents("o_totalprice").alias("y"))
    w = Window.partitionBy("series_id").orderBy("date")
    return days.select(
        "series_id", "date", F.col("date").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("cycle"), "y",
        F.lag("y", 1).over(w).alias("prev1"), F.lag("y", 7).over(w).alias("prev7"),
    ).dropna(subset=["prev7"])


CTES = {
    "bucket": """SELECT event_type AS series_id, time_bucket(INTERVAL '30 minutes', ts) AS ts,
        sum(round(value * 100)) / count(value) / 100 AS y, CAST(count(*) AS DOUBLE) AS load
        FROM events GROUP BY 1, 2""",
    "grid": """SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '30 minutes')) AS ts
        FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM bucket GROUP BY 1)""",
    "gridded": """SELECT series_id, ts, CAST(ts AS DATE) AS date,
        CAST(hour(ts) * 2 + minute(ts) // 30 AS INTEGER) AS cycle, y, load
        FROM grid LEFT JOIN bucket USING (series_id, ts)""",
    "seasoned": """SELECT series_id, ts, date, cycle, y IS NOT NULL AS y_observed,
        coalesce(y, lag(y, 336) OVER w) AS y, coalesce(load, lag(load, 336) OVER w) AS load
        FROM gridded WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "panel": """SELECT series_id, ts, date, cycle, y_observed,
        last_value(y IGNORE NULLS) OVER w AS y, last_value(load IGNORE NULLS) OVER w AS load
        FROM seasoned WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "rows": """SELECT * FROM (SELECT *,
        CASE WHEN cycle <= 15 THEN lag(y, 48) OVER w ELSE lag(y, 96) OVER w END AS b_1d,
        lag(y, 96) OVER w AS b_2d, lag(y, 144) OVER w AS b_3d, lag(y, 336) OVER w AS b_7d
        FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE b_7d IS NOT NULL""",
    "gated": """SELECT *, 20.0::DOUBLE / (20.0::DOUBLE + b_1d) AS prob, b_7d AS normal, b_2d AS low_pred FROM rows""",
    "odays": """SELECT * FROM (SELECT series_id, date, y, lag(y, 1) OVER w AS prev1, lag(y, 7) OVER w AS prev7 FROM (
        SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
        sum(round(o_totalprice * 100)) / count(*) / 100 AS y FROM orders GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY series_id ORDER BY date)) WHERE prev7 IS NOT NULL""",
}
PANEL = ("bucket", "grid", "gridded", "seasoned", "panel")
ROWS = (*PANEL, "rows")
GATED = (*ROWS, "gated")


def with_ctes(names, body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` behind the shared and its own common table expressions."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def errors_sql(y: str = "y", p: str = "pred", lim: Limits = LIMITS, gate: str | None = None) -> str:
    """The metric columns as SQL aggregates."""
    e, clean, low = f"abs({y} - {p})", f"({y} > {lim.low} AND {y} < {lim.high})", f"({y} <= {lim.low})"
    called = f"({p} <= {lim.low})"
    n_clean, n_low = f"count(*) FILTER ({clean})", f"count(*) FILTER ({low})"
    cols = [
        big("count(*)", "samples"), num(f"avg({e})", "mae"), num(f"sqrt(avg({e} * {e}))", "rmse"),
        num(f"100 * sum({e}) / sum(abs({y}))", "wmape"), big(n_clean, "clean_samples"),
        num(f"{n_clean} / count(*)", "valid_share"), num(f"avg({e}) FILTER ({clean})", "clean_mae"),
        num(f"sqrt(avg({e} * {e}) FILTER ({clean}))", "clean_rmse"),
        num(f"100 * avg({e} / abs({y})) FILTER ({clean})", "clean_mape"),
        num(f"100 * sum({e}) FILTER ({clean}) / sum(abs({y})) FILTER ({clean})", "clean_wmape"),
        big(n_low, "low_samples"), num(f"avg({e}) FILTER ({low})", "low_mae"),
        num(f"coalesce(count(*) FILTER ({low} AND {called}) / nullif(count(*) FILTER ({called}), 0), 0)", "low_precision"),
        num(f"coalesce(count(*) FILTER ({low} AND {called}) / nullif({n_low}, 0), 0)", "low_recall"),
    ]
    if gate:
        g = f"({gate} >= 0.5)"
        cols += [
            num(f"coalesce(count(*) FILTER ({low} AND {g}) / nullif(count(*) FILTER ({g}), 0), 0)", "gate_precision"),
            num(f"coalesce(count(*) FILTER ({low} AND {g}) / nullif({n_low}, 0), 0)", "gate_recall"),
        ]
    return ", ".join(cols)
