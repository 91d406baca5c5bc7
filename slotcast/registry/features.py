"""Lags, day statistics, rolling snapshots, proxies and calendar features."""

from pyspark.sql import functions as F

from slotcast.functions import calendar as cal
from slotcast.functions import proxies as px
from slotcast.functions.naming import candidate_name, parse_candidate
from slotcast.functions.numeric import row_median, row_sum
from slotcast.operators import daystats, lags
from slotcast.plans.features import FeatureSpec, add_features
from slotcast.registry.base import LIMITS, PANEL, big, event_panel, num, nums, query, read, text, with_ctes

W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
LOW = LIMITS.low


def _lag_sql(col: str, k: int) -> str:
    if k == 1:
        return f"CASE WHEN cycle <= 15 THEN lag({col}, 48) OVER w ELSE lag({col}, 96) OVER w END"
    return f"lag({col}, {48 * k}) OVER w"


@query(lambda: with_ctes(PANEL, "SELECT series_id, " + text("ts") + ", " + ", ".join(
    num(_lag_sql(c, k), f"{c}_same_cycle_{k}d") for c in ("y", "load") for k in (1, 2, 3, 7, 14, 28)) + f" FROM panel {W}"))
def same_slot_lags(spark, sf_dir):
    """Same-slot lags of two columns; the one-day lag falls back to two days after the cutoff."""
    df = lags.add_lags(event_panel(spark, sf_dir), {"y": "y_same_cycle", "load": "load_same_cycle"})
    return df.drop("date", "cycle", "y", "load", "y_observed")


MORNING = """SELECT series_id, date, avg(y) AS mean, median(y) AS med, stddev_samp(y) AS sd, max(y) AS mx, min(y) AS mn,
    arg_min(y, cycle) AS fst, arg_max(y, cycle) AS lst, avg((y <= 20)::INT) AS low, avg(load) AS lmean, stddev_samp(load) AS lsd,
    max(load) AS lmx, min(load) AS lmn, arg_min(load, cycle) AS lfst, arg_max(load, cycle) AS llst FROM (
    SELECT * FROM panel WHERE cycle <= 15) GROUP BY 1, 2"""


def _morning_sql():
    cols = {
        "morning_y_mean": "m.mean", "morning_y_median": "m.med", "morning_y_std": "m.sd", "morning_y_max": "m.mx",
        "morning_y_min": "m.mn", "morning_y_first": "m.fst", "morning_y_last": "m.lst", "morning_low_share": "m.low",
        "morning_y_range": "m.mx - m.mn", "morning_y_trend": "m.lst - m.fst", "morning_y_level_change": "m.mean - p.mean",
        "morning_load_mean": "m.lmean", "morning_load_std": "m.lsd", "morning_load_max": "m.lmx", "morning_load_min": "m.lmn",
        "morning_load_first": "m.lfst", "morning_load_last": "m.llst", "morning_load_range": "m.lmx - m.lmn",
        "morning_load_trend": "m.llst - m.lfst", "morning_load_level_change": "m.lmean - p.lmean",
    }
    sel = ", ".join(num(v, k) for k, v in cols.items())
    return with_ctes(PANEL, f"""SELECT d.series_id, {text('d.date', 'date')}, {sel} FROM (SELECT DISTINCT series_id, date FROM panel) d
        LEFT JOIN morning m ON m.series_id = d.series_id AND m.date = d.date - 1
        LEFT JOIN morning p ON p.series_id = d.series_id AND p.date = d.date - 2""", morning=MORNING)


@query(_morning_sql)
def morning_snapshot(spark, sf_dir):
    """Statistics of the origin day's morning and their change, for each target day."""
    days = daystats.half_days(event_panel(spark, sf_dir), "y", "load", limits=LIMITS, values=False)
    return days.select("series_id", "date", *[c.alias(n) for n, c in daystats.morning_features(days).items()])


@query(lambda: with_ctes(PANEL, f"""SELECT d.series_id, {text('d.date', 'date')}, {num('m.me', 'morning_y_north_mean')},
    {num('m.lm', 'morning_y_south_mean')}, {num('m.ye', 'morning_y_north_last')}, {num('m.le', 'morning_y_south_last')},
    {num('m.me - m.lm', 'morning_spread_ns_mean')}, {num('m.ye - m.le', 'morning_spread_ns_last')}
    FROM (SELECT DISTINCT series_id, date FROM panel) d LEFT JOIN (SELECT series_id, date, avg(y) AS me, avg(load) AS lm,
    arg_max(y, cycle) AS ye, arg_max(load, cycle) AS le FROM panel WHERE cycle <= 15 GROUP BY 1, 2) m
    ON m.series_id = d.series_id AND m.date = d.date - 1"""))
def regional_spread(spark, sf_dir):
    """Morning mean and last value of two regional columns and their spread."""
    days = daystats.half_days(event_panel(spark, sf_dir), "y", None, ("y", "load"), LIMITS, values=False)
    made = daystats.morning_features(days)
    keep = {n: c for n, c in made.items() if "north" in n or "south" in n or "spread" in n}
    return days.select("series_id", "date", *[c.alias(n) for n, c in keep.items()])


@query(lambda: with_ctes(PANEL, f"""SELECT p.series_id, {text('p.ts', 'ts')}, {num('d.m', 'prev_full_y_mean')}, {num('d.x', 'prev_full_y_max')},
    {num('d.n', 'prev_full_y_min')}, {num('d.s', 'prev_full_low_share')} FROM panel p LEFT JOIN (SELECT series_id, date, avg(y) AS m,
    max(y) AS x, min(y) AS n, avg((y <= {LOW})::INT) AS s FROM panel GROUP BY 1, 2) d
    ON d.series_id = p.series_id AND d.date = p.date - 2"""))
def previous_full_day(spark, sf_dir):
    """The newest complete day at the origin, on every slot of the target day."""
    df = event_panel(spark, sf_dir)
    days = daystats.half_days(df, "y", limits=LIMITS, values=False)
    feats = days.select("series_id", "date", *[c.alias(n) for n, c in daystats.full_day_features().items()])
    out = daystats.attach_day_features(df, feats)
    return out.select("series_id", "ts", *[c for c in out.columns if c.startswith("prev_full")])


def _snapshot_sql():
    def frame(n):
        return f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def guarded(expr, n, least, of="y"):
        return f"CASE WHEN count({of}) {frame(n)} >= {least} THEN {expr} {frame(n)} END"

    cols = {
        "y_rolling_std_1d": guarded("stddev_samp(y)", 48, 24), "y_rolling_std_7d": guarded("stddev_samp(y)", 336, 168),
        "y_rolling_mean_7d": guarded("avg(y)", 336, 168), "low_rate_7d": guarded("avg(lo)", 336, 168, "*"),
        "low_rate_30d": guarded("avg(lo)", 1440, 720, "*"),
        "y_rolling_median_7d": guarded("quantile_cont(y, 0.5)", 336, 84),
        "y_rolling_q90_7d": guarded("quantile_cont(y, 0.9)", 336, 84),
        "y_rolling_q98_7d": guarded("quantile_cont(y, 0.98)", 336, 84),
    }
    rolled = "SELECT series_id, date, cycle, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + (
        f" FROM (SELECT *, (y <= {LOW})::INT AS lo FROM panel)")
    return with_ctes(PANEL, f"""SELECT d.series_id, {text('d.date', 'date')}, {nums(*cols)} FROM (SELECT DISTINCT series_id, date
        FROM panel) d LEFT JOIN (SELECT * EXCLUDE (cycle) FROM rolled WHERE cycle = 15) r
        ON r.series_id = d.series_id AND r.date = d.date - 1""", rolled=rolled)


@query(_snapshot_sql)
def rolling_snapshot(spark, sf_dir):
    """Rolling moments, quantiles and low rates at the cutoff slot, for the next day."""
    days = daystats.half_days(event_panel(spark, sf_dir), "y", limits=LIMITS)
    snap = daystats.snapshot_features(days, "y", 7)
    return snap.select("series_id", "date", *[c for c in snap.columns if c not in days.columns])


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {text('ts')}, {num('lag(load, 96) OVER w', 'load_lag')},
    {num('CASE WHEN count(load) OVER f >= 168 THEN avg(load) OVER f END', 'load_rolling_7d')},
    {num('lag(load, 96) OVER w - lag(load, 432) OVER w', 'load_momentum')},
    {num('CASE WHEN count(y) OVER g >= 168 THEN avg(y) OVER g END', 'y_rolling_7d')},
    {num('CASE WHEN count(y) OVER h >= 720 THEN avg(y) OVER h END', 'y_rolling_30d')} FROM panel
    WINDOW w AS (PARTITION BY series_id ORDER BY ts),
    f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 431 PRECEDING AND 96 PRECEDING),
    g AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 383 PRECEDING AND 48 PRECEDING),
    h AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1487 PRECEDING AND 48 PRECEDING)"""))
def shifted_rolling_means(spark, sf_dir):
    """Week-long and month-long means that end one or two days back, from running sums."""
    df = lags.running_parts(event_panel(spark, sf_dir), ["load", "y"])
    return df.select(
        "series_id", "ts", lags.lag_days("load", 2).alias("load_lag"),
        lags.rolling_mean("load", 7, 2, 168).alias("load_rolling_7d"),
        (lags.lag_days("load", 2) - lags.lag_days("load", 9)).alias("load_momentum"),
        lags.rolling_mean("y", 7, 1, 168).alias("y_rolling_7d"),
        lags.rolling_mean("y", 30, 1, 720).alias("y_rolling_30d"),
    )


RANGES = (("1996-02-18", "1996-02-22"), ("1998-01-27", "1998-02-01"))


@query(lambda: f"""SELECT {text('date')}, {num('sin(2 * pi() * (isodow(date) - 1) / 7)', 'sin_dow')},
    {num('cos(2 * pi() * (isodow(date) - 1) / 7)', 'cos_dow')}, {num('sin(2 * pi() * month(date) / 12)', 'sin_month')},
    {num('cos(2 * pi() * month(date) / 12)', 'cos_month')}, {num('sin(2 * pi() * (d % 48) / 48)', 'sin_hour')},
    {num('cos(2 * pi() * (d % 48) / 48)', 'cos_hour')},
    {big('greatest((isodow(date) >= 6)::INT, f)', 'weekend')}, {big("greatest(f, (strftime(date, '%m-%d') IN ('01-01', '04-30', '05-01', '09-02') OR "
    + ' OR '.join(f"date BETWEEN '{a}' AND '{b}'" for a, b in RANGES) + ")::INT)", 'holiday')},
    {big('(year(date) >= 1998)::INT', 'late')}, {big('n', 'n')} FROM (SELECT CAST(o_orderdate AS DATE) AS date,
    day(o_orderdate) AS d, max((o_orderstatus = 'P' AND o_totalprice > 499000)::INT) AS f, count(*) AS n FROM orders GROUP BY 1, 2)""")
def calendar_features(spark, sf_dir):
    """Cyclic clock positions, weekend and holiday flags merged with a table's own, regime flag."""
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.max(((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 499000)).cast("int")).alias("f"), F.count("*").alias("n")
    ).withColumn("cycle", F.dayofmonth("date") % 48)
    return days.select(
        "date", *[c.alias(n) for n, c in cal.clock_features().items()],
        cal.weekend(flag="f").alias("weekend"), cal.holiday(flag="f", ranges=RANGES).alias("holiday"),
        cal.after_year(year=1998).alias("late"), "n",
    )


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {text('ts')}, {num('y / 1000 * load * 0.75', 'solar')}, {num('y / 10 * load * 0.3', 'wind')},
    {num('y - y / 1000 * load * 0.75 - y / 10 * load * 0.3', 'residual')}, {num('100 - coalesce(o, 0) - load', 'thermal')},
    {num('y / (load + 1)', 'per_load')}, {num('greatest(y - 35, 0)', 'heat')}, {num('greatest(15 - y, 0)', 'cold')},
    {num('coalesce(o, 0) + load', 'rain')}, {num('y_observed::INT * y', 'interaction')}
    FROM (SELECT *, CASE WHEN y_observed THEN load END AS o FROM panel)"""))
def supply_proxies(spark, sf_dir):
    """Generation, residual load, thermal capacity, ratios, temperature stress, column sums."""
    df = event_panel(spark, sf_dir).withColumn("o", F.when(F.col("y_observed"), F.col("load")))
    solar, wind = px.solar_output("y", "load"), px.wind_output("y", "load")
    return df.select(
        "series_id", "ts", solar.alias("solar"), wind.alias("wind"), px.residual_load("y", solar, wind).alias("residual"),
        px.thermal_capacity(F.lit(100.0), "o", "load").alias("thermal"), px.scarcity_ratio("y", "load").alias("per_load"),
        px.heat_stress("y").alias("heat"), px.cold_stress("y").alias("cold"), row_sum(["o", "load"]).alias("rain"),
        (F.col("y_observed").cast("int") * F.col("y")).alias("interaction"),
    )


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {text('ts')},
    {num('list_median([x for x in [a, b, c] if x is not null])', 'weekly_median')}, {num('a - b', 'momentum')},
    {num('b - list_median([x for x in [a, b, c] if x is not null])', 'level_vs_weekly')} FROM (SELECT series_id, ts,
    {_lag_sql('y', 1)} AS a, {_lag_sql('y', 2)} AS b, {_lag_sql('y', 7)} AS c FROM panel {W})"""))
def row_medians(spark, sf_dir):
    """Median across lag columns of a row, missing ones skipped, and momentum terms."""
    df = lags.add_lags(event_panel(spark, sf_dir), {"y": "l"}, (1, 2, 7))
    med = row_median(["l_1d", "l_2d", "l_7d"])
    return df.select(
        "series_id", "ts", med.alias("weekly_median"), (F.col("l_1d") - F.col("l_2d")).alias("momentum"),
        (F.col("l_2d") - med).alias("level_vs_weekly"),
    )


def _feature_sql():
    lagged = ", ".join(f"{_lag_sql(c, k)} AS {c}{k}" for c in ("y", "load") for k in (1, 2, 7, 14))
    days = """SELECT series_id, date, avg(y) FILTER (cycle <= 15) AS am, avg(y) AS full FROM panel GROUP BY 1, 2"""
    roll = """SELECT series_id, date, m7 FROM (SELECT series_id, date, cycle, CASE WHEN count(y) OVER f >= 168 THEN avg(y) OVER f END AS m7
        FROM panel WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 335 PRECEDING AND CURRENT ROW)) WHERE cycle = 15"""
    med = "list_median([x for x in [load1, load2, load7, load14] if x is not null])"
    return with_ctes(PANEL, f"""SELECT l.series_id, {text('l.ts', 'ts')}, {num('y1', 'y_same_cycle_1d')}, {num('a.am', 'morning_y_mean')},
        {num('b.full', 'prev_full_y_mean')}, {num('r.m7', 'y_rolling_mean_7d')}, {num('y1 - r.m7', 'y_dev_from_7d_mean')},
        {num(med, 'load_forecast_proxy')}, {num('load1 - load7', 'load_forecast_trend')},
        {num("load1 * (strftime(l.date, '%m-%d') = '01-01')::INT", 'holiday_load_impact')},
        {num('sin(2 * pi() * cycle / 48)', 'sin_hour')} FROM lagged l
        LEFT JOIN days a ON a.series_id = l.series_id AND a.date = l.date - 1
        LEFT JOIN days b ON b.series_id = l.series_id AND b.date = l.date - 2
        LEFT JOIN roll r ON r.series_id = l.series_id AND r.date = l.date - 1""",
        lagged=f"SELECT series_id, ts, date, cycle, {lagged} FROM panel {W}", days=days, roll=roll)


SPEC = FeatureSpec(
    y="y", y_stem="y", load="load", lagged=(("y", "y_same_cycle"), ("load", "load_same_cycle")), quantile_days=7, limits=LIMITS,
)


@query(_feature_sql)
def feature_plan(spark, sf_dir):
    """The whole feature plan on the panel; a sample of its columns."""
    out = add_features(event_panel(spark, sf_dir), SPEC)
    return out.select(
        "series_id", "ts", "y_same_cycle_1d", "morning_y_mean", "prev_full_y_mean", "y_rolling_mean_7d", "y_dev_from_7d_mean",
        "load_forecast_proxy", "load_forecast_trend", "holiday_load_impact", "sin_hour",
    )


@query(lambda: f"""SELECT name, split_part(name, '|', 1) AS base_candidate, {big("substr(split_part(name, '|', 2), 2)", 'bias_days')},
    {big("substr(split_part(name, '|', 3), 2)", 'cap_days')},
    {num("CASE WHEN name LIKE '%roff' THEN NULL ELSE CAST(substr(split_part(name, '|', 4), 2) AS DOUBLE) END", 'cap_ratio')}, {big('n', 'n')}
    FROM (SELECT concat(p_brand, '|b', p_size, '|c', p_partkey % 60, '|r',
    CASE WHEN p_size % 5 = 0 THEN 'off' ELSE printf('%.2f', p_size / 100) END) AS name, count(*) AS n FROM part GROUP BY 1)""")
def candidate_names(spark, sf_dir):
    """Candidate names built from their fields and parsed back."""
    ratio = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 100)
    names = read(spark, sf_dir, "part").groupBy(
        candidate_name("p_brand", "p_size", F.col("p_partkey") % 60, ratio).alias("name")
    ).agg(F.count("*").alias("n"))
    return names.select("name", *[c.alias(n) for n, c in parse_candidate("name").items()], "n")


