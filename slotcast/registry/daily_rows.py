"""Daily matrices, scaling and similar-day forecasts."""

from pyspark.sql import functions as F

from slotcast.operators import daily, similar
from slotcast.registry.base import PANEL, ROWS, big, event_panel, event_rows, num, query, text, with_ctes

SPLIT = "2024-01-20"
K = similar.NEIGHBOURS


@query(lambda: with_ctes(("bucket", "grid", "gridded"), f"""SELECT d.series_id, {text('d.date', 'date')}, {big('d.cycle', 'cycle')},
    {num('coalesce(f, b, 0)', 'y')}, {num('coalesce(first_load, 0)', 'load')} FROM (
    SELECT s.series_id, s.date, c.cycle, last_value(y IGNORE NULLS) OVER (PARTITION BY s.series_id, s.date ORDER BY c.cycle
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
    first_value(y IGNORE NULLS) OVER (PARTITION BY s.series_id, s.date ORDER BY c.cycle
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
    first_value(load IGNORE NULLS) OVER (PARTITION BY s.series_id, s.date ORDER BY c.cycle
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_load
    FROM (SELECT DISTINCT series_id, date FROM gridded) s CROSS JOIN (SELECT unnest(range(48)) AS cycle) c
    LEFT JOIN gridded g ON g.series_id = s.series_id AND g.date = s.date AND g.cycle = c.cycle) d"""))
def daily_matrix(spark, sf_dir):
    """Observed values as one 48-slot row per day, gaps filled within the day; first value of a scalar."""
    seen = event_panel(spark, sf_dir).where("y_observed")
    # every date of the grid, also one without a single observation
    dates = event_panel(spark, sf_dir).select("series_id", "date").distinct().withColumn("cycle", F.lit(0))
    rows = seen.select("series_id", "date", "cycle", "y", "load")
    empty = dates.join(rows, ["series_id", "date"], "left_anti").withColumns({
        "y": F.lit(None).cast("double"), "load": F.lit(None).cast("double")
    })
    days = daily.day_profiles(rows.unionByName(empty), ["y"], ["load"])
    return days.select("series_id", "date", F.posexplode("y").alias("cycle", "y"), "load")


@query(lambda: with_ctes(("bucket", "grid", "gridded"), "SELECT series_id, " + text("date") + ", " + ", ".join(
    num(f"max(y) FILTER (cycle = {c})", f"c{c:02d}") for c in range(48))
    + " FROM (SELECT *, y AS v FROM gridded) GROUP BY 1, date HAVING count(v) >= 40"))
def daily_targets(spark, sf_dir):
    """Days by slot columns, for days with at least 40 observed slots."""
    seen = event_panel(spark, sf_dir).where("y_observed")
    days = daily.day_profiles(seen, ["y"], fill=False)
    enough = days.where(F.size(F.filter("y", lambda v: v.isNotNull())) >= 40)
    return daily.slot_columns(enough, "y")


@query(lambda: with_ctes(PANEL, f"""SELECT p.series_id, {text('p.ts', 'ts')}, {num('CASE WHEN n = 48 THEN q.y END', 'pred')}
    FROM panel p LEFT JOIN panel q ON q.series_id = p.series_id AND q.ts = p.ts - INTERVAL 1 DAY
    LEFT JOIN (SELECT series_id, date, count(y) AS n FROM panel GROUP BY 1, 2) d ON d.series_id = p.series_id AND d.date = p.date - 1"""))
def daily_lookup(spark, sf_dir):
    """A daily forecast, yesterday's complete profile, looked up for every row."""
    df = event_panel(spark, sf_dir)
    yesterday = daily.daily_targets(df).withColumn("date", F.date_add("date", 1))
    return daily.rows_from_daily(df, yesterday).select("series_id", "ts", "pred")


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {big('cycle', 'pos')}, {num('median(b_1d)', 'center')},
    {num('CASE WHEN quantile_cont(b_1d, 0.9) - quantile_cont(b_1d, 0.1) > 0 THEN quantile_cont(b_1d, 0.9) - quantile_cont(b_1d, 0.1) ELSE 1 END', 'scale')}
    FROM full_days GROUP BY 1, cycle""", full_days="""SELECT * FROM rows WHERE (series_id, date) IN (
        SELECT (series_id, date) FROM rows GROUP BY series_id, date HAVING count(*) = 48)"""))
def robust_scaling(spark, sf_dir):
    """Median and 10-90 quantile range of every position of the daily matrix."""
    rows = event_rows(spark, sf_dir)
    days = daily.training_days(daily.daily_matrix(rows, ["b_1d"]), daily.daily_targets(rows))
    return daily.robust_params(days, "features")


def _vectors() -> dict[str, str]:
    """Scaled daily vectors of train and query days, and the K nearest pairs."""
    return {
        "days": """SELECT series_id, date, count(*) AS n FROM rows GROUP BY 1, 2""",
        "train": f"SELECT r.* FROM rows r JOIN days USING (series_id, date) WHERE n = 48 AND date < '{SPLIT}'",
        "params": """SELECT series_id, cycle, median(b_1d) AS c, quantile_cont(b_1d, 0.9) - quantile_cont(b_1d, 0.1) AS s
            FROM train GROUP BY 1, 2""",
        "t": "SELECT series_id, date, cycle, (b_1d - c) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM train JOIN params USING (series_id, cycle)",
        "filled": f"""SELECT series_id, date, c.cycle, coalesce(
                last_value(b_1d IGNORE NULLS) OVER (PARTITION BY series_id, date ORDER BY c.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(b_1d IGNORE NULLS) OVER (PARTITION BY series_id, date ORDER BY c.cycle ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS b
            FROM (SELECT series_id, date FROM days WHERE date >= '{SPLIT}') CROSS JOIN (SELECT unnest(range(48)) AS cycle) c
            LEFT JOIN rows USING (series_id, date, cycle)""",
        "q": "SELECT series_id, date, cycle, (b - c) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM filled JOIN params USING (series_id, cycle)",
        "near": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY distance, near_date) AS rank FROM (
            SELECT q.series_id, q.date, t.date AS near_date, avg((q.v - t.v) * (q.v - t.v)) AS distance
            FROM q JOIN t ON q.series_id = t.series_id AND q.cycle = t.cycle GROUP BY 1, 2, 3)) WHERE rank <= {K}""",
    }


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('date')}, {text('near_date')}, {num('distance', 'distance')}, {big('rank', 'rank')} FROM near", **_vectors()))
def nearest_days(spark, sf_dir):
    """The five training days closest to each later day, on scaled daily vectors."""
    train, query_days = _split(spark, sf_dir)
    fitted = daily.training_days(daily.daily_matrix(train, ["b_1d"]), daily.daily_targets(train))
    params = daily.robust_params(fitted, "features")
    scaled = daily.scale_days(fitted, params), daily.scale_days(daily.daily_matrix(query_days, ["b_1d"]), params)
    return similar.nearest_days(*scaled, k=K, block_days=8)


@query(lambda: with_ctes(ROWS, f"""SELECT k.series_id, {text('k.date', 'date')}, {big('y.cycle', 'cycle')}, {num('sum(w * y.y) / sum(w)', 'pred')}
    FROM (SELECT *, exp(-distance / (median(distance) OVER (PARTITION BY series_id, date) + 1e-9)) AS w FROM near) k
    JOIN train y ON y.series_id = k.series_id AND y.date = k.near_date GROUP BY k.series_id, k.date, y.cycle""", **_vectors()))
def similar_day_forecast(spark, sf_dir):
    """Kernel-weighted mean profile of the nearest days."""
    train, query_days = _split(spark, sf_dir)
    return similar.similar_days(train, query_days, ["b_1d"], k=K, block_days=8)


def _split(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    cut = F.lit(SPLIT).cast("date")
    return rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut)


