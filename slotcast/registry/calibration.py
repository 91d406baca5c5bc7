"""Metrics, trailing blends, bias and cap corrections."""

from pyspark.sql import functions as F

from slotcast.functions.weights import class_balance
from slotcast.operators import calibrate, metrics, models
from slotcast.registry.base import (
    GATED, LIMITS, ROWS, big, errors_sql, event_panel, event_rows, gated_rows, num, nums, query, read, text, with_ctes,
)

L = LIMITS
CLEAN = f"(y > {L.low} AND y < {L.high})"
MODELS = ("b_1d", "b_2d", "b_3d", "b_7d")
BACK, REVEAL = 7, 2


def clip_sql(x: str) -> str:
    return f"greatest(least({x}, {L.ceiling}), {L.floor})"


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, 'all' AS level, -1::BIGINT AS slot, -1::BIGINT AS ym, {errors_sql(p='b_1d')} FROM rows GROUP BY 1
    UNION ALL SELECT series_id, 'cycle', cycle::BIGINT, -1, {errors_sql(p='b_1d')} FROM rows GROUP BY 1, cycle
    UNION ALL SELECT series_id, 'month', -1, (year(date) * 100 + month(date))::BIGINT, {errors_sql(p='b_1d')} FROM rows GROUP BY series_id, year(date), month(date)"""))
def error_report(spark, sf_dir):
    """Errors overall, by slot and by month, from one scan."""
    rep = metrics.report(event_rows(spark, sf_dir), "y", "b_1d", limits=L)
    return rep.withColumns({
        "slot": F.coalesce("cycle", F.lit(-1)).cast("bigint"),
        "ym": F.coalesce(F.col("year") * 100 + F.col("month"), F.lit(-1)).cast("bigint"),
    }).drop("cycle", "year", "month")


@query(lambda: with_ctes(GATED, f"SELECT {errors_sql(p='normal', gate='w')} FROM (SELECT *, CASE WHEN prob >= 0.45 THEN 1.0 ELSE 0.0 END AS w FROM gated)"))
def gate_confusion(spark, sf_dir):
    """Errors of all series with both readings of a called event: forecast level and gate weight."""
    df = gated_rows(spark, sf_dir).withColumn("w", F.when(F.col("prob") >= 0.45, 1.0).otherwise(0.0))
    return metrics.metrics(df, [], "y", "normal", "w", L)


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {big(f'count(*) FILTER ({CLEAN})', 'clean_samples')},
    {num(f'avg(abs(y - p)) FILTER ({CLEAN})', 'baseline_mae')}, {num(f'100 * sum(abs(y - p)) FILTER ({CLEAN}) / sum(y) FILTER ({CLEAN})', 'baseline_wmape')}
    FROM (SELECT *, {clip_sql('b_7d')} AS p FROM rows) GROUP BY 1"""))
def naive_baseline(spark, sf_dir):
    """Clean error of a clipped lag column."""
    return metrics.baseline(event_rows(spark, sf_dir), "b_7d", ["series_id"], "y", L)


def _weights_ctes() -> dict[str, str]:
    frame = f"OVER (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL {BACK + REVEAL - 1} DAY PRECEDING AND INTERVAL {REVEAL} DAY PRECEDING)"
    errs = ", ".join(f"sum(abs(y - {m})) FILTER ({CLEAN}) AS e_{m}" for m in MODELS)
    inv = ", ".join(f"1 / greatest(sum(e_{m}) {frame} / nullif(sum(n) {frame}, 0), 25) AS i_{m}" for m in MODELS)
    total = " + ".join(f"i_{m}" for m in MODELS)
    w = ", ".join(f"CASE WHEN coalesce(n, 0) >= 48 THEN i_{m} / ({total}) ELSE 0.25 END AS w_{m}" for m in MODELS)
    return {
        "days": f"SELECT series_id, date, count(*) FILTER ({CLEAN}) AS n, {errs} FROM rows GROUP BY 1, 2",
        "inv": f"SELECT series_id, date, sum(n) {frame} AS n, {inv} FROM days",
        "weights": f"SELECT series_id, date, {w} FROM inv",
    }


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('date')}, {nums(*[f'w_{m}' for m in MODELS])} FROM weights", **_weights_ctes()))
def trailing_weights(spark, sf_dir):
    """Daily inverse-error weights of four forecasts over the trailing week."""
    return calibrate.blend_weights(event_rows(spark, sf_dir), list(MODELS), lookback_days=BACK, reveal_lag_days=REVEAL, limits=L)


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {text('ts')}, {num(' + '.join(f'{m} * w_{m}' for m in MODELS), 'blend')}
    FROM rows JOIN weights USING (series_id, date)""", **_weights_ctes()))
def trailing_blend(spark, sf_dir):
    """The four forecasts mixed with the weights of their day."""
    out = calibrate.trailing_blend(event_rows(spark, sf_dir), list(MODELS), lookback_days=BACK, reveal_lag_days=REVEAL, limits=L)
    return out.select("series_id", "ts", "blend")


def adjust_ctes(bias: int, cap: int, ratio: float, reveal: int) -> dict[str, str]:
    rows = f"ROWS BETWEEN {bias + reveal - 1} PRECEDING AND {reveal} PRECEDING"
    return {
        "resid": f"SELECT series_id, date, median(CASE WHEN {CLEAN} THEN y - b_1d END) AS r FROM rows GROUP BY 1, 2",
        "bias": f"""SELECT series_id, date, CASE WHEN count(r) OVER f >= 3 THEN quantile_cont(r, 0.5) OVER f END AS bias FROM resid
            WINDOW f AS (PARTITION BY series_id ORDER BY date {rows})""",
        "cap": f"""SELECT d.series_id, d.date, CASE WHEN count(h.y) >= 48 THEN quantile_cont(h.y, 0.98) END AS cap
            FROM (SELECT DISTINCT series_id, date FROM rows) d LEFT JOIN panel h ON h.series_id = d.series_id
            AND h.date BETWEEN d.date - {cap + reveal - 1} AND d.date - {reveal} GROUP BY 1, 2""",
        "shifted": """SELECT series_id, ts, date, b_1d + coalesce(bias, 0) AS p, bias, cap FROM rows
            JOIN bias USING (series_id, date) JOIN cap USING (series_id, date)""",
        "adjusted": f"""SELECT series_id, ts, {clip_sql(f'CASE WHEN cap IS NOT NULL AND p >= {ratio} * cap THEN cap ELSE p END')} AS adjusted FROM shifted""",
    }


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('ts')}, {nums('adjusted')} FROM adjusted", **adjust_ctes(7, 5, 0.9, 2)))
def walk_forward(spark, sf_dir):
    """Bias of the last week and cap of the last five days, safe at the origin, with older actuals as history."""
    rows = event_rows(spark, sf_dir).withColumn("base", F.col("b_1d"))
    out = calibrate.walk_forward_adjust(
        rows, event_panel(spark, sf_dir), bias_days=7, cap_days=5, cap_ratio=0.9, reveal_lag_days=2, limits=L
    )
    return out.select("series_id", "ts", "adjusted")


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('ts')}, {nums('adjusted')} FROM adjusted", **adjust_ctes(3, 7, 0.95, 1)))
def walk_forward_full_day(spark, sf_dir):
    """The same rules when the whole previous day counts as known."""
    rows = event_rows(spark, sf_dir).withColumn("base", F.col("b_1d"))
    out = calibrate.walk_forward_adjust(
        rows, event_panel(spark, sf_dir), bias_days=3, cap_days=7, cap_ratio=0.95, reveal_lag_days=1, limits=L
    )
    return out.select("series_id", "ts", "adjusted")


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('date')}, {nums('residual', 'bias')} FROM (SELECT series_id, date, r AS residual, bias FROM resid JOIN bias USING (series_id, date))",
    **{k: v for k, v in adjust_ctes(7, 5, 0.9, 2).items() if k in ("resid", "bias")}))
def trailing_bias(spark, sf_dir):
    """Median clean residual per day and its trailing median."""
    days = calibrate.daily_residual(event_rows(spark, sf_dir), "y", "b_1d", L)
    return calibrate.trailing_bias(days, 7, 2)


DAY = "2024-01-29"


@query(lambda: with_ctes(ROWS, f"""SELECT t.series_id, {text('t.ts', 'ts')}, {num(clip_sql(
    'CASE WHEN cap IS NOT NULL AND t.b_1d + coalesce(bias, 0) >= 0.9 * cap THEN cap ELSE t.b_1d + coalesce(bias, 0) END'), 'adjusted')}
    FROM rows t LEFT JOIN (SELECT series_id, CASE WHEN count(DISTINCT date) FILTER ({CLEAN} AND date >= DATE '{DAY}' - 7) >= 3
        THEN median(y - b_1d) FILTER ({CLEAN} AND date >= DATE '{DAY}' - 7) END AS bias,
        CASE WHEN count(*) FILTER (date >= DATE '{DAY}' - 10) >= 48 THEN quantile_cont(y, 0.98) FILTER (date >= DATE '{DAY}' - 10) END AS cap
        FROM rows WHERE date < DATE '{DAY}' GROUP BY 1) s USING (series_id) WHERE t.date = DATE '{DAY}'"""))
def single_day(spark, sf_dir):
    """One target day corrected from the days before it."""
    rows = event_rows(spark, sf_dir).withColumn("base", F.col("b_1d"))
    day = F.lit(DAY).cast("date")
    out = calibrate.single_day_adjust(
        rows.where(F.col("date") == day), rows, bias_days=7, cap_days=10, cap_ratio=0.9, limits=L
    )
    return out.select("series_id", "ts", "adjusted")


@query(lambda: with_ctes(("bucket", "grid", "gridded", "seasoned", "panel"), f"""SELECT series_id, {text('date')}, {big('count(*)', 'n')}, {num('sum(v)', 'total')} FROM (
    SELECT p.series_id, p.date, coalesce(b.load, p.y) AS v FROM panel p LEFT JOIN bucket b USING (series_id, ts)) GROUP BY 1, date"""))
def merged_actuals(spark, sf_dir):
    """History and revealed rows in one table, the revealed value replacing the older one."""
    df = event_panel(spark, sf_dir)
    history = df.select("series_id", "ts", "date", F.col("y").alias("v"))
    revealed = df.where("y_observed").select("series_id", "ts", "date", F.col("load").alias("v"))
    return calibrate.merge_revealed(history, revealed).groupBy("series_id", "date").agg(
        F.count("*").alias("n"), F.sum("v").alias("total")
    )


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {', '.join(num(f"CASE WHEN n >= 48 THEN i_{m} / ({' + '.join(f'i_{k}' for k in MODELS)}) ELSE 0.25 END", f'w_{m}') for m in MODELS)}
    FROM (SELECT series_id, count(*) FILTER ({CLEAN}) AS n, {', '.join(f'1 / greatest(avg(abs(y - {m})) FILTER ({CLEAN}), 25) AS i_{m}' for m in MODELS)} FROM rows GROUP BY 1)"""))
def component_weights(spark, sf_dir):
    """One set of inverse-error weights per series."""
    return calibrate.component_weights(event_rows(spark, sf_dir), list(MODELS), limits=L)


@query(lambda: f"""SELECT o_orderstatus, {num('sum(w)', 'total_weight')}, {num('sum(w * o_totalprice) / sum(w)', 'weighted_price')} FROM (
    SELECT *, pow(0.5, date_diff('second', o_orderdate, max(o_orderdate) OVER (PARTITION BY o_orderstatus)) / 86400 / 730) AS w FROM orders) GROUP BY 1""")
def recency_weights(spark, sf_dir):
    """Weights that halve every two years before the newest row of a group."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").alias("ts"), "o_totalprice"
    )
    return models.with_recency(rows, 730, "w").groupBy(F.col("series_id").alias("o_orderstatus")).agg(
        F.sum("w").alias("total_weight"), (F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w")).alias("weighted_price")
    )


@query(lambda: f"""SELECT {big('quality', 'quality')}, {big('pos', 'pos')}, {big('neg', 'neg')}, {num('CASE WHEN pos > 0 THEN greatest(least(neg / pos, 20), 1) END', 'balance')} FROM (
    SELECT quality, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM labels GROUP BY 1)""")
def class_balance_weight(spark, sf_dir):
    """Negatives per positive, clipped to 1..20."""
    n = read(spark, sf_dir, "labels").groupBy("quality").agg(
        F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")
    )
    return n.withColumn("balance", class_balance("pos", "neg"))


@query(lambda: f"""SELECT l_returnflag AS model, {big('greatest(least(floor(median(l_quantity * 20)), 800), 100)', 'iterations')} FROM lineitem GROUP BY 1""")
def iteration_choice(spark, sf_dir):
    """Median iteration count per model, clipped to 100..800."""
    history = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_quantity") * 20).alias("iterations")
    )
    return models.best_iteration(history)


@query(lambda: with_ctes(ROWS, f"""SELECT {text('date')}, {big('max(fold)', 'fold')}, {big('count(*)', 'n')} FROM (
    SELECT r.date, greatest(0, floor((pos - (total - 5 * (total // 6))) / (total // 6)) + 1) AS fold FROM rows r JOIN (
    SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM rows)) USING (date)) GROUP BY date"""))
def chronological_folds(spark, sf_dir):
    """Five equal blocks of last days for validation, everything earlier for training."""
    return models.day_folds(event_rows(spark, sf_dir), 5).groupBy("date").agg(F.max("fold").alias("fold"), F.count("*").alias("n"))
