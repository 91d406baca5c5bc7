"""Gates, slot bias, step bounds, the step guard and state projection."""

from pyspark.sql import functions as F

from slotcast.functions import regime as rg
from slotcast.operators import shape, tuning
from slotcast.registry.base import GATED, LIMITS, PANEL, ROWS, big, event_panel, event_rows, gated_rows, num, nums, query, text, with_ctes

L = LIMITS
CLEAN = f"(y > {L.low} AND y < {L.high})"
LOWER, CAPS = tuple(20.0 + 2 * i for i in range(13)), tuple(60.0 + 8 * i for i in range(11))
STATES = {"lower": (20.0, 40.0), "cap": 90.0, "min_rows": 50}
THRESHOLDS, RAMPS = tuning.GATE_THRESHOLDS, tuning.GATE_RAMPS


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {text('ts')}, {num('CASE WHEN prob >= 0.4 THEN 1 ELSE 0 END', 'step_weight')}, {num('w', 'weight')},
    {num(f'(1 - w) * normal + w * greatest(least(low_pred, {L.low}), 0)', 'gated')}, {num('(1 - prob) * normal + prob * low_pred', 'mixture')},
    {num('CASE WHEN normal >= 0.9 * 100 THEN 100 ELSE normal END', 'snapped')}, {num(f'greatest(least(normal, {L.ceiling}), {L.floor})', 'published')},
    {num('CASE WHEN w < 0.2 AND normal <= 25 THEN 22.5 WHEN w < 0.2 AND normal >= 110 THEN 130 ELSE normal END', 'projected')}
    FROM (SELECT *, greatest(least((prob - 0.3) / 0.2, 1), 0) AS w FROM gated)"""))
def gates_and_snaps(spark, sf_dir):
    """Step and ramp gate weights, hard and soft blends, cap snap, projection and final clip."""
    df = gated_rows(spark, sf_dir).withColumn("weight", rg.gate_weight("prob", 0.4, 0.1))
    return df.select(
        "series_id", "ts", rg.gate_weight("prob", 0.4, 0.0).alias("step_weight"), "weight",
        rg.gate_blend("normal", "low_pred", "weight", L).alias("gated"), rg.soft_mixture("prob", "normal", "low_pred").alias("mixture"),
        rg.cap_snap("normal", F.lit(100.0), 0.9).alias("snapped"), rg.publishable("normal", L).alias("published"),
        rg.project_states("normal", "weight", 25.0, 110.0, 22.5, 130.0).alias("projected"),
    )


BIAS = f"""SELECT series_id, cycle, coalesce(greatest(least(n / (n + 96) * m, 40), -40), 0) AS slot_bias FROM (
    SELECT series_id, cycle, count(*) FILTER ({CLEAN}) AS n, median(y - b_7d) FILTER ({CLEAN}) AS m FROM rows GROUP BY 1, 2)"""


@query(lambda: with_ctes(ROWS, f"SELECT series_id, {text('ts')}, {num('b_7d + slot_bias', 'pred')} FROM rows JOIN bias USING (series_id, cycle)", bias=BIAS))
def slot_bias(spark, sf_dir):
    """Shrunken median residual per slot, added to the forecast."""
    rows = event_rows(spark, sf_dir).withColumn("pred", F.col("b_7d"))
    return shape.apply_slot_bias(rows, shape.slot_bias(rows, limits=L)).select("series_id", "ts", "pred")


def _bounds() -> dict[str, str]:
    def q(side, p, src):
        return f"quantile_cont(delta, {p}) FILTER ({'normal' if side == 'n' else 'NOT normal'}) AS {src}{side}{'lo' if p < 0.5 else 'hi'}"

    qs = [("n", 0.01), ("n", 0.99), ("g", 0.005), ("g", 0.995)]
    return {
        "steps": f"""SELECT series_id, date, cycle, y - prev AS delta, coalesce(y > {L.low} AND prev > {L.low}, false) AS normal FROM (
            SELECT *, lag(y) OVER w AS prev, row_number() OVER w AS r FROM panel WINDOW w AS (PARTITION BY series_id, date ORDER BY ts)) WHERE r > 1""",
        "own": f"""SELECT series_id, cycle, count(*) FILTER (normal) AS nn, count(*) FILTER (NOT normal) AS ng,
            {', '.join(q(s, p, 's') for s, p in qs)} FROM steps GROUP BY 1, 2""",
        "pooled": f"SELECT series_id, {', '.join(q(s, p, 'a') for s, p in qs)} FROM steps GROUP BY 1",
        "bounds": """SELECT series_id, cycle, least(CASE WHEN nn >= 15 THEN snlo ELSE anlo END, -2.0) AS normal_lo,
            greatest(CASE WHEN nn >= 15 THEN snhi ELSE anhi END, 2.0) AS normal_hi,
            least(CASE WHEN ng >= 15 THEN sglo ELSE aglo END, -8.0) AS gate_lo,
            greatest(CASE WHEN ng >= 15 THEN sghi ELSE aghi END, 8.0) AS gate_hi
            FROM (SELECT DISTINCT series_id, cycle FROM panel) LEFT JOIN own USING (series_id, cycle) LEFT JOIN pooled USING (series_id)""",
    }


def _spark_bounds(spark, sf_dir):
    return shape.step_bounds(event_panel(spark, sf_dir), min_rows=15, normal_floor=2.0, gate_floor=8.0, limits=L)


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {big('cycle', 'cycle')}, {nums('normal_lo', 'normal_hi', 'gate_lo', 'gate_hi')}
    FROM bounds""", **_bounds()))
def step_bounds(spark, sf_dir):
    """Step quantiles per slot, the series' own where a slot has too few."""
    return _spark_bounds(spark, sf_dir)


def _guard() -> dict[str, str]:
    return {
        **{k: v for k, v in _bounds().items()},
        "halved": """SELECT *, normal_lo / 4 AS nlo, normal_hi / 4 AS nhi, gate_lo / 4 AS glo, gate_hi / 4 AS ghi FROM bounds""",
        "input": """SELECT series_id, date, cycle, ts, y, normal AS p, greatest(least((prob - 0.3) / 0.2, 1), 0) AS w, nlo, nhi, glo, ghi,
            row_number() OVER (PARTITION BY series_id, date ORDER BY cycle) AS r FROM gated JOIN halved USING (series_id, cycle)""",
        "walk": """SELECT series_id, date, r, ts, y, p, w, p AS v FROM input WHERE r = 1
            UNION ALL SELECT i.series_id, i.date, i.r, i.ts, i.y, i.p, i.w, walk.v + CASE WHEN greatest(i.w, walk.w) >= 0.2 OR abs(i.w - walk.w) >= 0.2
            THEN greatest(least(i.p - walk.v, ghi), glo) ELSE greatest(least(i.p - walk.v, nhi), nlo) END
            FROM walk JOIN input i ON i.series_id = walk.series_id AND i.date = walk.date AND i.r = walk.r + 1""",
    }


def _spark_guard(spark, sf_dir):
    quarter = _spark_bounds(spark, sf_dir)
    quarter = quarter.select("series_id", "cycle", *[(F.col(c) / 4).alias(c) for c in quarter.columns if c[-3:] in ("_lo", "_hi")])
    df = gated_rows(spark, sf_dir).withColumns({"weight": rg.gate_weight("prob", 0.4, 0.1), "pred": F.col("normal")})
    return shape.step_guard(df.select("series_id", "date", "cycle", "ts", "y", "pred", "weight"), quarter)


@query(lambda: with_ctes(GATED, f"SELECT series_id, {text('ts')}, {num('v', 'guarded')} FROM walk", recursive=True, **_guard()))
def step_guard(spark, sf_dir):
    """Every step of a day held to its bounds, each from the held value before it."""
    return _spark_guard(spark, sf_dir).select("series_id", "ts", "guarded")


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {nums('raw_mae', 'guarded_mae', 'raw_clean_mae', 'guarded_clean_mae')},
    {big('guarded_clean_mae <= raw_clean_mae + 1 AND guarded_mae <= raw_mae + 1', 'guard_on')} FROM (SELECT series_id, avg(abs(y - p)) AS raw_mae,
    avg(abs(y - v)) AS guarded_mae, avg(abs(y - p)) FILTER ({CLEAN}) AS raw_clean_mae, avg(abs(y - v)) FILTER ({CLEAN}) AS guarded_clean_mae
    FROM walk GROUP BY 1)""", recursive=True, **_guard()))
def guard_decision(spark, sf_dir):
    """Whether the guard is worth having, by its error."""
    return shape.guard_helps(_spark_guard(spark, sf_dir), limits=L)


def _sweep() -> dict[str, str]:
    return {
        "cuts": f"SELECT unnest([{', '.join(str(t) + '::DOUBLE' for t in tuning.SWEEP)}]) AS threshold",
        "counted": f"""SELECT series_id, threshold, count(*) AS n, count(*) FILTER (y <= {L.low}) AS events,
            count(*) FILTER (y <= {L.low} AND prob >= threshold) AS tp, count(*) FILTER (y > {L.low} AND prob >= threshold) AS fp
            FROM gated CROSS JOIN cuts GROUP BY 1, 2""",
        "sweep": """SELECT *, 5 * precision * recall / greatest(4 * precision + recall, 1e-12) AS f2 FROM (SELECT *, tp / greatest(tp + fp, 1) AS precision,
            tp / greatest(events, 1) AS recall, fp / greatest(n - events, 1) AS fpr, events / n AS prevalence FROM counted)""",
    }


def _spark_sweep(spark, sf_dir):
    return tuning.threshold_sweep(gated_rows(spark, sf_dir), rg.is_low("y", L), "prob")


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {num('threshold', 'threshold')}, {big('n', 'n')}, {big('events', 'events')}, {big('tp', 'tp')},
    {big('fp', 'fp')}, {nums('precision', 'recall', 'fpr', 'prevalence', 'f2')} FROM sweep""", **_sweep()))
def threshold_sweep(spark, sf_dir):
    """Precision, recall, false-positive rate and F2 at 38 thresholds."""
    return _spark_sweep(spark, sf_dir)


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {num('coalesce(max(threshold) FILTER (r = 1 AND ok), 1.1)', 'threshold')},
    {big('count(*) FILTER (ok)', 'admissible')} FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ok DESC, f2 DESC, recall DESC,
    precision DESC, threshold) AS r FROM (SELECT *, precision >= greatest(0.25, least(0.6, 1.5 * prevalence)) AND fpr <= 0.25 AS ok FROM sweep)) GROUP BY 1""", **_sweep()))
def threshold_choice(spark, sf_dir):
    """The admissible threshold of highest F2."""
    return tuning.best_threshold(_spark_sweep(spark, sf_dir), max_fpr=0.25)


def _gate() -> dict[str, str]:
    return {
        "combos": f"SELECT t::DOUBLE AS threshold, r::DOUBLE AS ramp FROM (SELECT unnest({list(THRESHOLDS)}) AS t) CROSS JOIN (SELECT unnest({list(RAMPS)}) AS r) UNION ALL SELECT NULL, NULL",
        "scored": f"""SELECT series_id, threshold, ramp, y, abs(y - ((1 - w) * normal + w * greatest(least(low_pred, {L.low}), 0))) AS e FROM (
            SELECT *, CASE WHEN threshold IS NULL THEN 0 WHEN ramp = 0 THEN (prob >= threshold)::INT::DOUBLE
            ELSE greatest(least((prob - (threshold - ramp)) / (2 * ramp), 1), 0) END AS w FROM gated CROSS JOIN combos)""",
        "gates": f"""SELECT series_id, threshold, ramp, avg(e) FILTER ({CLEAN}) AS clean_mae, avg(e) AS overall_mae,
            avg(e) FILTER (y <= {L.low}) AS low_mae FROM scored GROUP BY 1, 2, 3""",
    }


def _spark_gates(spark, sf_dir):
    return tuning.gate_grid(gated_rows(spark, sf_dir), thresholds=THRESHOLDS, ramps=RAMPS, limits=L)


@query(lambda: with_ctes(GATED, f"SELECT series_id, {nums('threshold', 'ramp', 'clean_mae', 'overall_mae', 'low_mae')} FROM gates", **_gate()))
def gate_grid(spark, sf_dir):
    """Error of every gate threshold and ramp."""
    return _spark_gates(spark, sf_dir)


@query(lambda: with_ctes(GATED, f"""SELECT b.series_id, {num('coalesce(g.threshold, 1.1)', 'threshold')}, {num('coalesce(g.ramp, 0.05)', 'ramp')}
    FROM (SELECT * FROM gates WHERE threshold IS NULL) b LEFT JOIN (SELECT g.*, row_number() OVER (PARTITION BY g.series_id ORDER BY round(g.overall_mae, 9), g.threshold, g.ramp) AS r
    FROM gates g JOIN gates b ON b.series_id = g.series_id AND b.threshold IS NULL AND g.threshold IS NOT NULL
    AND g.clean_mae <= b.clean_mae + 2.5 AND g.overall_mae < b.overall_mae - 1e-9) g ON g.series_id = b.series_id AND g.r = 1""", **_gate()))
def gate_choice(spark, sf_dir):
    """The gate that lowers overall error most without hurting the clean band."""
    return tuning.best_gate(_spark_gates(spark, sf_dir))


def _states() -> dict[str, str]:
    lo, hi = STATES["lower"]
    low, cap = f"(y > {lo} AND y < {hi})", f"(y >= {STATES['cap']})"
    enough = f"count(*) FILTER ({low}) >= {STATES['min_rows']} AND count(*) FILTER ({cap}) >= {STATES['min_rows']}"
    return {
        "levels": f"""SELECT series_id, CASE WHEN {enough} THEN median(y) FILTER ({low}) END AS lower_value,
            CASE WHEN {enough} THEN median(y) FILTER ({cap}) END AS cap_value,
            count(*) FILTER ({low}) AS lower_rows, count(*) FILTER ({cap}) AS cap_rows FROM panel GROUP BY 1""",
        "pairs": f"""SELECT * FROM (SELECT unnest({[*LOWER, None]}::DOUBLE[]) AS lower_cut) CROSS JOIN (SELECT unnest({[*CAPS, None]}::DOUBLE[]) AS cap_cut)
            WHERE lower_cut IS NULL OR cap_cut IS NULL OR lower_cut < cap_cut""".replace("None", "NULL"),
        "moved": f"""SELECT series_id, date_trunc('month', date) AS month, lower_cut, cap_cut, {CLEAN} AS clean, abs(y - normal) AS base,
            abs(y - CASE WHEN w < 0.2 AND normal <= lower_cut THEN lower_value WHEN w < 0.2 AND normal >= cap_cut THEN cap_value ELSE normal END) AS e
            FROM (SELECT *, greatest(least((prob - 0.3) / 0.2, 1), 0) AS w FROM gated) JOIN (SELECT * FROM levels WHERE lower_value IS NOT NULL) USING (series_id)
            CROSS JOIN pairs""",
        "monthly": """SELECT series_id, lower_cut, cap_cut, month, count(*) AS n, sum(e) AS e, count(*) FILTER (clean) AS nc,
            coalesce(sum(e) FILTER (clean), 0) AS ec, coalesce(sum(base) FILTER (clean), 0) AS bc FROM moved GROUP BY 1, 2, 3, 4""",
        "projections": """SELECT series_id, lower_cut, cap_cut, sum(ec) / nullif(sum(nc), 0) AS clean_mae, sum(e) / sum(n) AS overall_mae,
            count(*) FILTER (nc > 0 AND ec <= bc + 1e-9) AS months_ok, count(*) FILTER (nc > 0) AS months FROM monthly GROUP BY 1, 2, 3""",
    }


def _spark_levels(spark, sf_dir):
    return tuning.state_levels(event_panel(spark, sf_dir), **STATES)


def _spark_projections(spark, sf_dir):
    df = gated_rows(spark, sf_dir).withColumns({"weight": rg.gate_weight("prob", 0.4, 0.1), "pred": F.col("normal")})
    return tuning.projection_grid(df, _spark_levels(spark, sf_dir), lower_cuts=LOWER, cap_cuts=CAPS, limits=L)


@query(lambda: with_ctes(PANEL, f"""SELECT series_id, {nums('lower_value', 'cap_value')}, {big('lower_rows', 'lower_rows')}, {big('cap_rows', 'cap_rows')}
    FROM levels""", levels=_states()["levels"]))
def state_levels(spark, sf_dir):
    """Median of the lower and of the cap price state."""
    return _spark_levels(spark, sf_dir)


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {nums('lower_cut', 'cap_cut', 'clean_mae', 'overall_mae')}, {big('months_ok', 'months_ok')},
    {big('months', 'months')} FROM projections""", **_states()))
def projection_grid(spark, sf_dir):
    """Error of every pair of projection cuts, and the months it does not hurt."""
    return _spark_projections(spark, sf_dir)


@query(lambda: with_ctes(GATED, f"""SELECT series_id, {nums('lower_cut', 'cap_cut', 'clean_mae', 'overall_mae')}, {big('months_ok', 'months_ok')}, {big('months', 'months')}
    FROM (SELECT p.*, row_number() OVER (PARTITION BY p.series_id ORDER BY round(p.clean_mae, 9), coalesce(p.lower_cut, -1), coalesce(p.cap_cut, -1)) AS r
    FROM projections p JOIN projections b ON b.series_id = p.series_id AND b.lower_cut IS NULL AND b.cap_cut IS NULL
    AND NOT (p.lower_cut IS NULL AND p.cap_cut IS NULL) AND p.clean_mae < b.clean_mae - 1e-9 AND p.overall_mae <= b.overall_mae + 1e-9
    AND p.months_ok >= greatest(1, ceil(p.months * 0.6))) WHERE r = 1""", **_states()))
def projection_choice(spark, sf_dir):
    """The pair of cuts that helps most in enough months."""
    return tuning.best_projection(_spark_projections(spark, sf_dir))


