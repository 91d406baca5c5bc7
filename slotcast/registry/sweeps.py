"""Candidate sweep over years, scoreboard and choice; ridge blend; serving frame."""

from pyspark.sql import functions as F

from slotcast.operators import blend, models
from slotcast.plans import pretest, serve
from slotcast.registry.base import (
    DAY_LIMITS, PANEL, ROWS, big, errors_sql, event_panel, event_rows, num, nums, order_days, query, read, text, with_ctes,
)

D = DAY_LIMITS
CONFIGS = pretest.CONFIGS
MAE, WMAPE, YEARS, MIN_CAP = 100000.0, 40.0, 7, 10
CLEAN = f"(y > {D.low} AND y < {D.high})"


def _sweep() -> dict[str, str]:
    """Every candidate and configuration, row by row."""
    out = {"r": "SELECT *, year(date) AS year FROM odays"}
    for c in ("prev1", "prev7"):
        out[f"res_{c}"] = f"SELECT series_id, year, date, median(CASE WHEN {CLEAN} THEN y - {c} END) AS v FROM r GROUP BY 1, 2, 3"
    for k in (14, 28, 56):
        out[f"cap{k}"] = f"""SELECT d.series_id, d.date, CASE WHEN count(h.y) >= {MIN_CAP} THEN quantile_cont(h.y, 0.98) END AS cap
            FROM odays d LEFT JOIN odays h ON h.series_id = d.series_id AND h.date BETWEEN d.date - {k + 1} AND d.date - 2 GROUP BY 1, 2"""
    parts = []
    for c in ("prev1", "prev7"):
        for b, k, ratio in CONFIGS:
            name = f"{c}|b{b}|c{k}|r{'off' if ratio is None else f'{ratio:.2f}'}"
            if b:
                bias = f"""(SELECT series_id, date, CASE WHEN count(v) OVER f >= 3 THEN quantile_cont(v, 0.5) OVER f END AS bias FROM res_{c}
                    WINDOW f AS (PARTITION BY series_id, year ORDER BY date ROWS BETWEEN {b + 1} PRECEDING AND 2 PRECEDING))"""
                src = f"""SELECT r.series_id, year, y, {c} + coalesce(bias, 0) AS p, cap FROM r JOIN {bias} USING (series_id, date)
                    JOIN cap{k} USING (series_id, date)"""
                pred = f"CASE WHEN cap IS NOT NULL AND p >= {ratio} * cap THEN cap ELSE p END"
            else:
                src, pred = f"SELECT series_id, year, y, {c} AS p FROM r", "p"
            parts.append(f"SELECT series_id, year, '{name}' AS candidate, y, greatest(least({pred}, {D.ceiling}), {D.floor}) AS pred FROM ({src})")
    out["preds"] = " UNION ALL ".join(parts)
    out["swept"] = f"SELECT series_id, {big('year', 'year')}, candidate, {errors_sql(lim=D)} FROM preds GROUP BY series_id, year, candidate"
    raw = f"avg(abs(y - pred)) FILTER ({CLEAN}) AS cm, 100 * sum(abs(y - pred)) FILTER ({CLEAN}) / sum(abs(y)) FILTER ({CLEAN}) AS cw"
    low = f"(y <= {D.low})"
    out["scored"] = f"""SELECT *, greatest(cm / {MAE}, cw / {WMAPE}) AS ratio FROM (SELECT series_id, year, candidate, {raw},
        100 * sum(abs(y - pred)) / sum(abs(y)) AS wmape,
        coalesce(count(*) FILTER ({low} AND pred <= {D.low}) / nullif(count(*) FILTER ({low}), 0), 0) AS recall FROM preds GROUP BY 1, 2, 3)"""
    out["board"] = f"""SELECT series_id, candidate, count(*) AS years, max(ratio) AS worst_ratio, max(wmape) AS worst_wmape, min(recall) AS min_low_recall,
        bool_and(cm < {MAE} AND cw < {WMAPE}) AS target_met FROM scored GROUP BY 1, 2 HAVING count(*) = {YEARS}"""
    return out


def _spark_sweep(spark, sf_dir):
    return pretest.sweep(order_days(spark, sf_dir), ["prev1", "prev7"], CONFIGS, min_cap_rows=MIN_CAP, limits=D)


@query(lambda: with_ctes(("odays",), "SELECT * FROM swept", **_sweep()))
def pretest_sweep(spark, sf_dir):
    """Two forecasts under all eight corrections, scored per series and year."""
    return _spark_sweep(spark, sf_dir)


@query(lambda: with_ctes(("odays",), f"""SELECT series_id, candidate, {big('years', 'years')}, {nums('worst_ratio', 'worst_wmape', 'min_low_recall')},
    {big('target_met', 'target_met')} FROM board""", **_sweep()))
def candidate_scoreboard(spark, sf_dir):
    """The worst year of every candidate that has all of them."""
    return pretest.scoreboard(_spark_sweep(spark, sf_dir), YEARS, MAE, WMAPE)


@query(lambda: with_ctes(("odays",), f"""SELECT series_id, candidate, {nums('worst_ratio', 'worst_wmape')} FROM (SELECT b.*, row_number() OVER (PARTITION BY b.series_id
    ORDER BY worst_wmape, worst_ratio, candidate) AS r FROM board b JOIN (SELECT series_id, min(worst_ratio) AS m FROM board GROUP BY 1) USING (series_id)
    WHERE worst_ratio <= m + 0.05) WHERE r = 1""", **_sweep()))
def candidate_choice(spark, sf_dir):
    """Among near-best candidates the one with the lowest overall error."""
    board = pretest.scoreboard(_spark_sweep(spark, sf_dir), YEARS, MAE, WMAPE)
    return pretest.select_candidate(board, 0.05).select("series_id", "candidate", "worst_ratio", "worst_wmape")


@query(lambda: with_ctes(("odays",), f"""SELECT series_id, {big('year', 'year')}, candidate, {num('ratio', 'ratio')}, {num('cm', 'clean_mae')}, {num('cw', 'clean_wmape')},
    {num('recall', 'low_recall')} FROM (SELECT *, row_number() OVER (PARTITION BY series_id, year ORDER BY ratio, candidate) AS r FROM scored) WHERE r = 1""", **_sweep()))
def best_candidate_per_year(spark, sf_dir):
    """The candidate nearest to the targets in each year."""
    return pretest.best_per_year(_spark_sweep(spark, sf_dir), MAE, WMAPE)


ALPHAS = blend.ALPHAS
N_FOLDS = 5


def _ridge() -> dict[str, str]:
    def solve(src):
        """Closed form for two forecasts from centred moments."""
        return f"""SELECT series_id, fold, alpha, my - w1 * m1 - w2 * m2 AS b, w1, w2 FROM (SELECT *,
            ((s22 + alpha) * s1y - s12 * s2y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
            ((s11 + alpha) * s2y - s12 * s1y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2 FROM {src} CROSS JOIN alphas)"""

    def mom(cond):
        return f"""avg(b_1d) AS m1, avg(b_7d) AS m2, avg(y) AS my, var_pop(b_1d) * count(*) AS s11, var_pop(b_7d) * count(*) AS s22,
            covar_pop(b_1d, b_7d) * count(*) AS s12, covar_pop(b_1d, y) * count(*) AS s1y, covar_pop(b_7d, y) * count(*) AS s2y
            FROM folded f {cond}"""

    return {
        "folds": f"""SELECT date, greatest(0, floor((pos - (total - {N_FOLDS} * (total // {N_FOLDS + 1}))) / (total // {N_FOLDS + 1})) + 1)::INT AS fold FROM (
            SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM rows))""",
        "folded": "SELECT r.*, fold FROM rows r JOIN folds USING (date)",
        "alphas": f"SELECT unnest([{', '.join(str(a) + '::DOUBLE' for a in ALPHAS)}]) AS alpha",
        "cvm": f"SELECT f.series_id, v.fold, {mom(f'JOIN (SELECT unnest(range(1, {N_FOLDS + 1})) AS fold) v ON f.fold < v.fold GROUP BY 1, 2')}",
        "allm": f"SELECT series_id, 0 AS fold, {mom('GROUP BY 1, 2')}",
        "cv": solve("cvm"),
        "err": """SELECT series_id, alpha, avg(mae) AS mae FROM (SELECT f.series_id, f.fold, alpha, avg(abs(y - (b + w1 * b_1d + w2 * b_7d))) AS mae
            FROM folded f JOIN cv ON cv.series_id = f.series_id AND cv.fold = f.fold GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "best": "SELECT series_id, alpha, mae FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(mae, 9), alpha) AS r FROM err) WHERE r = 1",
        "final": solve("allm"),
    }


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {num('alpha', 'alpha')}, {num('b', 'intercept')}, {num('w1', 'w_1d')}, {num('w2', 'w_7d')}, {num('mae', 'cv_mae')}
    FROM best JOIN final USING (series_id, alpha)""", **_ridge()))
def ridge_blend(spark, sf_dir):
    """L2-penalised blend of two forecasts, the penalty chosen by chronological validation."""
    folded = models.day_folds(event_rows(spark, sf_dir), N_FOLDS)
    out = blend.ridge_blend(folded, ["b_1d", "b_7d"], alphas=ALPHAS)
    return out.select(
        "series_id", "alpha", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("w_1d"), F.col("coef")[2].alias("w_7d"), "cv_mae"
    )


ORIGIN = "2024-01-20"


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {text('date')}, {big('count(*)', 'n')}, {big('count(y)', 'known')}, {num('sum(coalesce(disp_load, 0))', 'carried')},
    {big('coalesce(max(flag), -1)', 'flag')} FROM (
    SELECT series_id, date, cycle, y, load AS disp_load, NULL AS flag FROM panel WHERE ts <= '{ORIGIN} 07:30:00'
    UNION ALL SELECT s.series_id, d.date, c.cycle, NULL, CASE WHEN d.date > '{ORIGIN}' THEN s.l END, CASE WHEN d.date > '{ORIGIN}' THEN k.flag END FROM (
        SELECT series_id, arg_max(load, ts) AS l FROM panel WHERE ts <= '{ORIGIN} 07:30:00' GROUP BY 1) s
        CROSS JOIN (SELECT unnest([DATE '{ORIGIN}', DATE '{ORIGIN}' + 1])::DATE AS date) d CROSS JOIN (SELECT unnest(range(48)) AS cycle) c
        LEFT JOIN (SELECT CAST(ts AS DATE) AS date, (count(*) % 7)::INT AS flag FROM events GROUP BY 1) k ON k.date = d.date
        WHERE d.date > '{ORIGIN}' OR c.cycle > 15) GROUP BY 1, date"""))
def future_frame(spark, sf_dir):
    """The panel cut at the origin, the unknown rest of the day and an empty target day."""
    df = event_panel(spark, sf_dir).withColumnRenamed("load", "disp_load").withColumn("flag", F.lit(None).cast("int"))
    calendar = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg((F.count("*") % 7).cast("int").alias("flag"))
    full = serve.future_frame(df, ORIGIN, calendar, y="y")
    return full.groupBy("series_id", "date").agg(
        F.count("*").alias("n"), F.count("y").alias("known"), F.sum(F.coalesce("disp_load", F.lit(0.0))).alias("carried"),
        F.coalesce(F.max("flag"), F.lit(-1)).alias("flag"),
    )


@query(lambda: with_ctes(ROWS, f"""SELECT series_id, {big('count(*)', 'rows')}, {text('min(date)', 'first_day')}, {text('max(date)', 'last_day')} FROM rows
    WHERE date < DATE '{ORIGIN}' AND date >= DATE '{ORIGIN}' - 10 GROUP BY 1"""))
def serving_history(spark, sf_dir):
    """Complete rows of the days before the origin day."""
    _, history = serve.split_day(event_rows(spark, sf_dir), ["b_1d", "b_7d"], ORIGIN, "y", 10)
    return history.groupBy("series_id").agg(F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


