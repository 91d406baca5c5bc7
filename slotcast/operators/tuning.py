"""Grids of thresholds scored in one pass: no row is multiplied by the grid.

Every grid point is a conditional aggregate, an entry of an aggregated array or a prefix sum of the places where
rows change, so what leaves the partial aggregation is bounded by series and grid, and the grid is unfolded after that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.numeric import clip
from slotcast.functions.regime import is_clean, is_low
from slotcast.limits import Limits

# fixed values: the default grids
SWEEP = tuple(round(0.05 + 0.025 * i, 3) for i in range(38))
GATE_THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(16))
GATE_RAMPS = (0.0, 0.05, 0.10)
LOWER_CUTS = tuple(1150.0 + 25.0 * i for i in range(13))
CAP_CUTS = tuple(1450.0 + 25.0 * i for i in range(11))
# Sums depend on their order in the last digits; errors this close are equal.
NOISE = 1e-9


def threshold_sweep(df: DataFrame, event: Column, prob: str, thresholds=SWEEP) -> DataFrame:
    """Per series and threshold: precision, recall, false-positive rate and F2 of ``prob >= threshold``.

    Also the prevalence and whether the threshold is admissible.
    """
    flagged = df.dropna(subset=[prob]).select("series_id", F.col(prob).alias("p"), event.alias("e")).dropna()
    points = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.count_if(F.col("e") & (F.col("p") >= t)).alias("tp"),
            F.count_if(~F.col("e") & (F.col("p") >= t)).alias("fp"),
        )
        for t in thresholds
    ]
    per = flagged.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("e")).alias("events"), F.array(*points).alias("g")
    ).select("series_id", "n", "events", F.inline("g"))
    ratios = per.withColumns({
        "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
        "recall": F.col("tp") / F.greatest(F.col("events"), F.lit(1)),
        "fpr": F.col("fp") / F.greatest(F.col("n") - F.col("events"), F.lit(1)),
        "prevalence": F.col("events") / F.col("n"),
    })
    p, r = F.col("precision"), F.col("recall")
    return ratios.withColumn("f2", 5.0 * p * r / F.greatest(4.0 * p + r, F.lit(1e-12)))


def best_threshold(sweep: DataFrame, max_fpr: float = 0.0025, off: float = 1.1) -> DataFrame:
    """Per series: the threshold of highest F2, then recall, then precision, then lowest; else ``off``.

    Precision must reach 1.5 times the prevalence, kept between 0.25 and 0.60.
    """
    least = F.greatest(F.lit(0.25), F.least(F.lit(0.60), 1.5 * F.col("prevalence")))
    ok = (F.col("precision") >= least) & (F.col("fpr") <= max_fpr)
    order = F.struct("f2", "recall", "precision", -F.col("threshold"))
    best = F.max_by("threshold", F.when(ok, order))
    return sweep.groupBy("series_id").agg(F.coalesce(best, F.lit(off)).alias("threshold"), F.count_if(ok).alias("admissible"))


def count_below(value: Column, steps: list[float], strict: bool = False, lo: int = 0, hi: int | None = None) -> Column:
    """How many of the ascending ``steps`` are at or below ``value`` (``strict``: below it), by halving."""
    hi = len(steps) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    under = F.lit(steps[mid]) < value if strict else F.lit(steps[mid]) <= value
    return F.when(under, count_below(value, steps, strict, mid + 1, hi)).otherwise(count_below(value, steps, strict, lo, mid))


def _error_steps(ramp: float, steps: list[float]) -> Column:
    """Where a row's error changes its course along the thresholds: structs of index, constant and slope to add from there.

    Up to threshold ``p - ramp`` the low forecast counts in full, from ``p + ramp`` on not at all. Between them the
    residual is a line in the threshold, so its size is one or two lines. Row columns: p, off (y - normal), gap (low - normal).
    """
    p, off, gap = F.col("__p"), F.col("__off"), F.col("__gap")
    gated, free = F.abs(off - gap), F.abs(off)

    def entry(at, constant, slope=F.lit(0.0)):
        return F.struct(F.lit(at).cast("int").alias("k") if isinstance(at, int) else at.cast("int").alias("k"), constant.alias("c"), slope.alias("s"))

    start = count_below(p - ramp, steps)
    if ramp <= 0:
        return F.array(entry(0, gated), entry(start, free - gated))
    stop = count_below(p + ramp, steps, strict=True)
    slope = gap / (2 * ramp)
    base = off - gap * (p + ramp) / (2 * ramp)
    turn = F.when(slope != 0, -base / slope)
    bend = F.greatest(start, F.least(stop, F.coalesce(count_below(turn, steps, strict=True), start)))
    between = start < stop
    before = F.when(between, -F.signum(slope)).otherwise(0.0)
    after = F.when(between, F.when(slope == 0, F.signum(base)).otherwise(F.signum(slope))).otherwise(0.0)
    return F.array(
        entry(0, gated),
        entry(start, before * base - gated, before * slope),
        entry(bend, (after - before) * base, (after - before) * slope),
        entry(stop, free - after * base, -after * slope),
    )


def _labelled(ramp: int):
    """Adds the number of the ramp to a struct of `_error_steps`."""
    return lambda e: F.struct(F.lit(ramp).alias("r"), e["k"].alias("k"), e["c"].alias("c"), e["s"].alias("s"))


def gate_grid(
    df: DataFrame,
    y: str = "y",
    normal: str = "normal",
    low: str = "low_pred",
    prob: str = "prob",
    thresholds=GATE_THRESHOLDS,
    ramps=GATE_RAMPS,
    limits: Limits = Limits(),
) -> DataFrame:
    """Per series, threshold and ramp: clean, overall and low-regime error of the gated blend.

    Row with NULL threshold: no gate. Along the thresholds a row's error is made of lines with at most three breaks.
    Only those are summed, per series, ramp and index; prefix sums over the few indices give all errors. So the work per row
    does not grow with the number of thresholds. A threshold above 1 switches the gate off.
    """
    steps = sorted({float(t) for t in thresholds if t <= 1.0})
    rows = df.dropna(subset=[y, normal, low, prob]).select(
        "series_id", F.col(prob).cast("double").alias("__p"), (F.col(y) - F.col(normal)).alias("__off"),
        (clip(low, 0.0, limits.low) - F.col(normal)).alias("__gap"), is_clean(y, limits).alias("__clean"), is_low(y, limits).alias("__low"),
    )
    kinds = {"overall": F.lit(True), "clean": F.col("__clean"), "low": F.col("__low")}
    totals = rows.groupBy("series_id").agg(
        *[F.count_if(inside).alias(f"n_{k}") for k, inside in kinds.items()],
        *[F.sum(F.when(inside, F.abs("__off"))).alias(f"e_{k}") for k, inside in kinds.items()],
    )
    base = totals.select(
        "series_id", F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("ramp"),
        *[(F.col(f"e_{k}") / F.nullif(F.col(f"n_{k}"), F.lit(0))).alias(f"{k}_mae") for k in ("clean", "overall", "low")],
    )
    courses = [F.transform(_error_steps(float(r), steps), _labelled(i)) for i, r in enumerate(ramps)]
    breaks = rows.select("series_id", "__clean", "__low", F.explode(F.concat(*courses)).alias("e")).where(F.col("e.k") < len(steps))
    added = breaks.groupBy("series_id", F.col("e.r").alias("r"), F.col("e.k").alias("k")).agg(
        *[F.sum(F.when(inside, F.col(f"e.{x}"))).alias(f"{x}_{k}") for k, inside in kinds.items() for x in ("c", "s")]
    )
    places = F.explode(F.expr(f"sequence(k, {len(steps) - 1})"))
    summed = added.withColumn("j", places).groupBy("series_id", "r", "j").agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in kinds for x in ("c", "s")])
    at = F.get(F.array(*[F.lit(t) for t in steps]), F.col("j"))
    ramp_of = F.get(F.array(*[F.lit(float(r)) for r in ramps]), F.col("r"))
    points = summed.join(totals, "series_id").select(
        "series_id", at.alias("threshold"), ramp_of.alias("ramp"),
        *[((F.col(f"c_{k}") + F.col(f"s_{k}") * at) / F.nullif(F.col(f"n_{k}"), F.lit(0))).alias(f"{k}_mae") for k in ("clean", "overall", "low")],
    )
    out = base.unionByName(points)
    for t in (float(t) for t in thresholds if t > 1.0):
        for r in ramps:
            out = out.unionByName(base.withColumns({"threshold": F.lit(t), "ramp": F.lit(float(r))}))
    return out


def best_gate(grid: DataFrame, clean_slack: float = 2.5, off: float = 1.1, off_ramp: float = 0.05) -> DataFrame:
    """Per series: lowest overall error that beats no gate and costs at most ``clean_slack`` clean error."""
    base = grid.where(F.col("threshold").isNull()).select(
        "series_id", F.col("clean_mae").alias("b_clean"), F.col("overall_mae").alias("b_all")
    )
    j = grid.where(F.col("threshold").isNotNull()).join(base, "series_id")
    ok = (F.col("clean_mae") <= F.col("b_clean") + clean_slack) & (F.col("overall_mae") < F.col("b_all") - NOISE)
    order = F.struct(F.round("overall_mae", 9), "threshold", "ramp")
    pick = F.min_by(F.struct("threshold", "ramp"), F.when(ok, order))
    best = j.groupBy("series_id").agg(pick.alias("p"))
    return best.select(
        "series_id",
        F.coalesce(F.col("p")["threshold"], F.lit(off)).alias("threshold"),
        F.coalesce(F.col("p")["ramp"], F.lit(off_ramp)).alias("ramp"),
    )


def state_levels(df: DataFrame, y: str = "y", lower=(500.0, 1200.0), cap: float = 1700.0, min_rows: int = 100) -> DataFrame:
    """Per series: median of the lower price state and of the cap state; NULL unless both are frequent."""
    v = F.col(y)
    low, high = (v > lower[0]) & (v < lower[1]), v >= cap
    enough = (F.count_if(low) >= min_rows) & (F.count_if(high) >= min_rows)
    return df.groupBy("series_id").agg(
        F.when(enough, F.median(F.when(low, v))).alias("lower_value"),
        F.when(enough, F.median(F.when(high, v))).alias("cap_value"),
        F.count_if(low).alias("lower_rows"), F.count_if(high).alias("cap_rows"),
    )


def projection_grid(
    df: DataFrame,
    levels: DataFrame,
    y: str = "y",
    pred: str = "pred",
    weight: str = "weight",
    lower_cuts=LOWER_CUTS,
    cap_cuts=CAP_CUTS,
    gate_limit: float = 0.20,
    limits: Limits = Limits(),
) -> DataFrame:
    """Per series and pair of cuts: clean and overall error, and in how many months it does not get worse.

    With the lower cut below the cap cut a row is moved by one of them at most, so the
    change in error of a pair is the sum of its two parts. Per month only those parts are
    aggregated, and pairs are formed from the monthly sums. NULL cuts leave a side alone.
    """
    known = levels.where(F.col("lower_value").isNotNull() & F.col("cap_value").isNotNull())
    j = df.dropna(subset=[y, pred, weight]).join(known.select("series_id", "lower_value", "cap_value"), "series_id")
    clean = is_clean(y, limits)
    j = j.select(
        "series_id", F.trunc("date", "month").alias("month"), F.col(pred).alias("p"),
        (F.col(weight) < gate_limit).alias("outside"), clean.alias("clean"),
        F.abs(F.col(y) - F.col(pred)).alias("e"),
        (F.abs(F.col(y) - F.col("lower_value")) - F.abs(F.col(y) - F.col(pred))).alias("dl"),
        (F.abs(F.col(y) - F.col("cap_value")) - F.abs(F.col(y) - F.col(pred))).alias("dc"),
    )

    def part(cond: Column, v: str, only_clean: bool) -> Column:
        cond = F.col("outside") & cond
        return F.sum(F.when(cond & F.col("clean") if only_clean else cond, F.col(v)).otherwise(0.0))

    def parts(only_clean: bool) -> list[Column]:
        lows = [part(F.col("p") <= c, "dl", only_clean) for c in lower_cuts] + [F.lit(0.0)]
        caps = [part(F.col("p") >= c, "dc", only_clean) for c in cap_cuts] + [F.lit(0.0)]
        return [F.array(*lows), F.array(*caps)]

    (al, ac), (cl, cc) = parts(False), parts(True)
    months = j.groupBy("series_id", "month").agg(
        F.count("*").alias("n"), F.sum("e").alias("e"), F.count_if("clean").alias("n_clean"),
        F.sum(F.when(F.col("clean"), F.col("e")).otherwise(0.0)).alias("e_clean"),
        al.alias("al"), ac.alias("ac"), cl.alias("cl"), cc.alias("cc"),
    )
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(k).alias("k"),
            F.lit(lo).cast("double").alias("lower_cut"), F.lit(hi).cast("double").alias("cap_cut"),
        )
        for i, lo in enumerate([*lower_cuts, None])
        for k, hi in enumerate([*cap_cuts, None])
        if lo is None or hi is None or lo < hi
    ])
    grid = months.select("*", F.inline(pairs))
    d_all = F.get("al", F.col("i")) + F.get("ac", F.col("k"))
    d_clean = F.get("cl", F.col("i")) + F.get("cc", F.col("k"))
    return grid.groupBy("series_id", "lower_cut", "cap_cut").agg(
        (F.sum(F.col("e_clean") + d_clean) / F.nullif(F.sum("n_clean"), F.lit(0))).alias("clean_mae"),
        (F.sum(F.col("e") + d_all) / F.sum("n")).alias("overall_mae"),
        F.count_if((F.col("n_clean") > 0) & (d_clean <= 0)).alias("months_ok"),
        F.count_if(F.col("n_clean") > 0).alias("months"),
    )


def best_projection(grid: DataFrame, month_share: float = 0.60) -> DataFrame:
    """Per series: the pair of lowest clean error that lowers it, does not hurt overall and holds in most months.

    A series without one is absent. Ties go to the pair with fewer and lower cuts.
    """
    none = F.col("lower_cut").isNull() & F.col("cap_cut").isNull()
    base = grid.where(none).select("series_id", F.col("clean_mae").alias("b_clean"), F.col("overall_mae").alias("b_all"))
    j = grid.where(~none).join(base, "series_id")
    needed = F.greatest(F.lit(1), F.ceil(F.col("months") * month_share))
    better = F.col("clean_mae") < F.col("b_clean") - NOISE
    ok = better & (F.col("overall_mae") <= F.col("b_all") + NOISE) & (F.col("months_ok") >= needed)
    order = F.struct(F.round("clean_mae", 9), F.coalesce("lower_cut", F.lit(-1.0)), F.coalesce("cap_cut", F.lit(-1.0)))
    return (
        j.where(ok).groupBy("series_id")
        .agg(F.min_by(F.struct("lower_cut", "cap_cut", "clean_mae", "overall_mae", "months_ok", "months"), order).alias("p"))
        .select("series_id", "p.*")
    )
