"""Gridding, joining, de-duplication, filters."""

from pyspark.sql import functions as F

from slotcast.functions.numeric import finite
from slotcast.operators import lags, metrics, panel, policy
from slotcast.registry.base import (
    LIMITS, PANEL, ROWS, big, cents, errors_sql, event_panel, event_rows, num, nums, query, read, text, with_ctes,
)


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {errors_sql(p='b_1d')} FROM rows GROUP BY 1"))
def seasonal_naive_score(spark, sf_dir):
    """Grid, impute, origin-safe lag, score: the smallest end-to-end forecast."""
    return metrics.metrics(event_rows(spark, sf_dir), ["series_id"], "y", "b_1d", limits=LIMITS)


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {text('ts')}, {text('date')}, {big('cycle', 'cycle')},
    {big('y_observed', 'y_observed')}, {nums('y', 'load')} FROM panel"""))
def imputed_panel(spark, sf_dir):
    """Every half hour of every series, seasonally then forward filled."""
    return event_panel(spark, sf_dir).select("series_id", "ts", "date", "cycle", "y_observed", "y", "load")


@query(lambda: with_ctes(("bucket", "grid", "gridded"), f"""SELECT series_id, {text('date')}, {big('count(*)', 'slots')},
    {big('count(y)', 'filled')}, {num('sum(y)', 'total')} FROM gridded GROUP BY 1, date"""))
def raw_grid(spark, sf_dir):
    """The grid before imputation: slots and filled slots per day."""
    ev = read(spark, sf_dir, "events")
    joined = panel.attach(panel.make_grid(ev, "event_type"), panel.to_slots(ev, "event_type", "ts", y=cents("value")))
    return joined.groupBy("series_id", "date").agg(
        F.count("*").alias("slots"), F.count("y").alias("filled"), F.sum("y").alias("total")
    )


@query(lambda: f"""SELECT user_id, event_type, event_id, {num('value', 'value')} FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedup_keep_first(spark, sf_dir):
    """First event of each user and type."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return panel.dedup_first(ev, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(lambda: f"""SELECT {text('ts')}, {nums('hydro_l_quantity', 'hydro_l_extendedprice', 'hydro_l_discount')} FROM (
    SELECT l_shipdate AS ts, avg(q) AS hydro_l_quantity, avg(p) AS hydro_l_extendedprice, avg(d) AS hydro_l_discount FROM (
    SELECT l_suppkey, l_shipdate, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_discount) AS d
    FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def two_level_rollup(spark, sf_dir):
    """Flows summed and levels averaged per source and time, then averaged over sources."""
    li = read(spark, sf_dir, "lineitem")
    out = panel.plant_rollup(li, "l_suppkey", "l_shipdate", ["l_quantity", "l_extendedprice"], ["l_discount"])
    return out.withColumnRenamed("l_shipdate", "ts")


@query(lambda: f"""SELECT {big('p_size', 'p_size')}, {', '.join(
    num(f"max(CASE WHEN contains(lower(p_type), '{p}') THEN {v} END)", f'{n}_{s}')
    for n, p in (('econ', 'econ'), ('small', 'small'), ('o', 'o'))
    for s, v in (('price', 'p_retailprice'), ('key', 'CAST(p_partkey AS DOUBLE)')))}
    FROM part WHERE contains(lower(p_type), 'econ') OR contains(lower(p_type), 'small') OR contains(lower(p_type), 'o') GROUP BY 1""")
def label_pivot(spark, sf_dir):
    """Columns per label, by case-insensitive substring of a text; labels may overlap."""
    labels = {"econ": "Econ", "small": "SMALL", "o": "o"}
    return panel.label_pivot(
        read(spark, sf_dir, "part"), "p_type", labels, ["p_size"],
        price=F.col("p_retailprice"), key=F.col("p_partkey").cast("double"),
    )


@query(lambda: f"""WITH hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
    sum(round(value * 100)) / count(*) / 100 AS v FROM events GROUP BY 1, 2),
    g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '30 minutes')) AS ts FROM (
        SELECT series_id, min(ts) AS lo, max(ts) + INTERVAL '30 minutes' AS hi FROM hourly GROUP BY 1))
    SELECT g.series_id, {text('g.ts', 'ts')}, {num('h.v', 'v')} FROM g ASOF LEFT JOIN hourly h
    ON g.series_id = h.series_id AND g.ts >= h.ts""")
def hourly_upsample(spark, sf_dir):
    """Hourly values on the half-hour grid, each carried forward until the next."""
    ev = read(spark, sf_dir, "events")
    hourly = ev.groupBy(
        F.col("event_type").alias("series_id"),
        (F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))).alias("ts"),
    ).agg(cents("value").alias("v"))
    return panel.upsample_ffill(hourly, ["v"], ["series_id"]).select("series_id", "ts", "v")


@query(lambda: f"""WITH dim AS (SELECT date, v, k FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, o_orderkey AS k,
    row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1)
    SELECT l_linestatus AS series_id, {text('CAST(l_shipdate AS DATE)', 'date')}, {big('count(*)', 'n')},
    {num('max(v)', 'price')}, {big('coalesce(max(k), -1)', 'last_key')}
    FROM lineitem LEFT JOIN dim ON CAST(l_shipdate AS DATE) = dim.date GROUP BY 1, 2""")
def daily_dimension(spark, sf_dir):
    """A date-keyed table mapped onto rows, the last of several rows for a date winning."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("date"))
    dim = read(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k")
    )
    return panel.attach_daily(li, dim, ["v", "k"], ["k"]).groupBy("series_id", "date").agg(
        F.count("*").alias("n"), F.max("v").alias("price"), F.coalesce(F.max("k"), F.lit(-1)).alias("last_key")
    )


@query(lambda: f"""SELECT l_returnflag, {big('count(*)', 'n')}, {big('count(r)', 'present')}, {num('avg(r)', 'mean_ratio')} FROM (
    SELECT l_returnflag, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS r FROM lineitem) GROUP BY 1""")
def infinite_to_missing(spark, sf_dir):
    """A ratio that is infinite or NaN for a zero denominator becomes missing."""
    li = read(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_discount") != 0, F.col("l_tax") / F.col("l_discount")).otherwise(
        F.when(F.col("l_tax") > 0, float("inf")).otherwise(float("nan"))
    )
    return li.select("l_returnflag", finite(raw).alias("r")).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("r").alias("present"), F.avg("r").alias("mean_ratio")
    )


def _profile_sql():
    cols = ["y", "load", "y_same_cycle_1d", "y_same_cycle_2d", "y_same_cycle_14d"]
    parts = [
        f"SELECT '{c}' AS name, {num(f'avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)', 'share')}, "
        f"{big(f'CASE WHEN count(DISTINCT {c}) > 1 THEN 1 ELSE 0 END', 'varies')} FROM laggy" for c in cols
    ]
    laggy = """SELECT y, load, CASE WHEN cycle <= 15 THEN lag(y, 48) OVER w ELSE lag(y, 96) OVER w END AS y_same_cycle_1d,
        lag(y, 96) OVER w AS y_same_cycle_2d, lag(y, 672) OVER w AS y_same_cycle_14d
        FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""
    return with_ctes(PANEL, " UNION ALL ".join(parts), laggy=laggy)


@query(_profile_sql)
def column_profile(spark, sf_dir):
    """Not-null share and variation of every numeric column: the basis of feature selection."""
    df = lags.add_lags(event_panel(spark, sf_dir), {"y": "y_same_cycle"}, (1, 2, 14))
    return policy.column_profile(df, policy.numeric_columns(df, ("cycle",)))


@query(lambda: with_ctes(PANEL, """SELECT name FROM (VALUES ('y_same_cycle_1d'), ('y_same_cycle_2d'), ('y_same_cycle_14d')) t(name)
    JOIN (SELECT avg((a IS NOT NULL)::INT) AS s1, avg((b IS NOT NULL)::INT) AS s2, avg((c IS NOT NULL)::INT) AS s3 FROM laggy) s
    ON CASE name WHEN 'y_same_cycle_1d' THEN s1 WHEN 'y_same_cycle_2d' THEN s2 ELSE s3 END >= 0.9""",
    laggy="""SELECT CASE WHEN cycle <= 15 THEN lag(y, 48) OVER w ELSE lag(y, 96) OVER w END AS a, lag(y, 96) OVER w AS b,
        lag(y, 672) OVER w AS c FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)"""))
def selected_features(spark, sf_dir):
    """Names that pass the availability policy and the data checks."""
    df = lags.add_lags(event_panel(spark, sf_dir), {"y": "y_same_cycle"}, (1, 2, 14))
    rules = policy.Policy(target="y", observed=frozenset({"load", "cycle"}))
    names = policy.select_features(df, rules, 0.9)
    return policy.column_profile(df, names).select("name")


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {big('count(*)', 'n')}, {num('sum(y)', 'total')}, {text('min(ts)', 'first_ts')},
    {text('max(ts)', 'last_ts')} FROM rows WHERE ts >= '2024-01-10' AND ts < '2024-01-20' GROUP BY 1"""))
def training_range(spark, sf_dir):
    """Rows in a time range with target and all features present."""
    df = lags.add_lags(event_panel(spark, sf_dir), {"y": "b"}, (1, 7))
    return policy.training_rows(df, ["b_1d", "b_7d"], "2024-01-10", "2024-01-20").groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum("y").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(lambda: f"""SELECT series_id, {text('latest')} FROM (SELECT event_type AS series_id, max(ts) AS latest
    FROM events GROUP BY 1) WHERE latest < '2024-01-30 23:45:00'""")
def stale_history(spark, sf_dir):
    """Series without an observation at the origin."""
    ev = read(spark, sf_dir, "events").withColumnRenamed("event_type", "series_id")
    return policy.stale_series(ev, F.lit("2024-01-30 23:45:00").cast("timestamp_ntz"), "value")


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {text('ts')}, {nums('b_1d', 'b_7d')}, {num('0', 'unseen')} FROM rows"""))
def aligned_columns(spark, sf_dir):
    """The fitted columns in fitted order, an absent one as 0."""
    return policy.align(event_rows(spark, sf_dir), ["b_1d", "b_7d", "unseen"], ("series_id", "ts"))


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {big('count(*)', 'n')}, {num('sum(y)', 'total')} FROM (SELECT *,
    dense_rank() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM panel) WHERE r <= 5 GROUP BY 1"""))
def newest_days(spark, sf_dir):
    """Rows of the last five dates of each series."""
    return policy.last_days(event_panel(spark, sf_dir), 5).groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum("y").alias("total")
    )


