"""Rules on the shape of a day's forecast: slot bias, step bounds and the step guard."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.numeric import clip
from slotcast.functions.regime import is_clean
from slotcast.limits import SLOTS, Limits
from slotcast.operators.frames import by_day


def slot_bias(df: DataFrame, y: str = "y", pred: str = "pred", shrink: float = 96.0, limit: float = 40.0, limits: Limits = Limits()) -> DataFrame:
    """Per series and slot: median clean residual, shrunk by its sample size and clipped."""
    r = F.when(is_clean(y, limits), F.col(y) - F.col(pred))
    n = F.count(r)
    bias = clip(n / (n + shrink) * F.median(r), -limit, limit)
    return df.groupBy("series_id", "cycle").agg(F.coalesce(bias, F.lit(0.0)).alias("slot_bias"))


def apply_slot_bias(df: DataFrame, bias: DataFrame, pred: str = "pred") -> DataFrame:
    """Shift every forecast by its slot's bias."""
    joined = df.join(bias, ["series_id", "cycle"], "left")
    return joined.withColumn(pred, F.col(pred) + F.coalesce("slot_bias", F.lit(0.0))).drop("slot_bias")


def day_steps(df: DataFrame, y: str = "y", limits: Limits = Limits()) -> DataFrame:
    """Change from the previous slot of the same day, and whether both ends are above the low limit.

    The first slot of a day has no step. A step with a missing end is not normal.
    """
    prev = F.lag(y).over(by_day())
    normal = F.coalesce((F.col(y) > limits.low) & (F.col("__prev") > limits.low), F.lit(False))
    staged = df.withColumns({"__prev": prev, "__first": F.row_number().over(by_day()) == 1})
    return staged.where(~F.col("__first")).select(
        "series_id", "date", "cycle", (F.col(y) - F.col("__prev")).alias("delta"), normal.alias("normal")
    )


def step_bounds(
    df: DataFrame,
    y: str = "y",
    min_rows: int = 50,
    normal_floor: float = 100.0,
    gate_floor: float = 500.0,
    limits: Limits = Limits(),
) -> DataFrame:
    """Per series and slot: how far a step may go, normally and around the low regime.

    Quantiles of the slot's own steps, or of all the series' steps when it has fewer
    than ``min_rows``; never tighter than the floors.
    """
    steps = day_steps(df, y, limits)
    normal, gate = F.when(F.col("normal"), F.col("delta")), F.when(~F.col("normal"), F.col("delta"))

    def tails(prefix: str) -> list:
        return [
            F.percentile(normal, F.array(F.lit(0.01), F.lit(0.99))).alias(f"{prefix}_nq"),
            F.percentile(gate, F.array(F.lit(0.005), F.lit(0.995))).alias(f"{prefix}_gq"),
        ]

    own = steps.groupBy("series_id", "cycle").agg(
        F.count_if(F.col("normal")).alias("n_normal"), F.count_if(~F.col("normal")).alias("n_gate"), *tails("s")
    )
    pooled = steps.groupBy("series_id").agg(*tails("a"))
    slots = df.select("series_id", "cycle").distinct()
    j = slots.join(own, ["series_id", "cycle"], "left").join(pooled, "series_id", "left")
    nq = F.when(F.coalesce("n_normal", F.lit(0)) >= min_rows, F.col("s_nq")).otherwise(F.col("a_nq"))
    gq = F.when(F.coalesce("n_gate", F.lit(0)) >= min_rows, F.col("s_gq")).otherwise(F.col("a_gq"))
    return j.select(
        "series_id", "cycle",
        F.least(nq[0], F.lit(-normal_floor)).alias("normal_lo"), F.greatest(nq[1], F.lit(normal_floor)).alias("normal_hi"),
        F.least(gq[0], F.lit(-gate_floor)).alias("gate_lo"), F.greatest(gq[1], F.lit(gate_floor)).alias("gate_hi"),
    )


def step_guard(df: DataFrame, bounds: DataFrame, pred: str = "pred", weight: str = "weight", out: str = "guarded", jump: float = 0.20) -> DataFrame:
    """Walk through each day and hold every step to its slot's bounds.

    Each value depends on the guarded value before it, so this is a fold over the day's
    rows, at most 48, not a window. Gate bounds apply where the gate is or was open, or
    its weight jumps. Days are independent.
    """
    cols = df.columns
    j = df.join(bounds, ["series_id", "cycle"], "left")
    rest = [c for c in cols if c not in ("series_id", "date", "cycle")]
    packed = j.groupBy("series_id", "date").agg(
        F.array_sort(F.collect_list(F.struct("cycle", *rest, "normal_lo", "normal_hi", "gate_lo", "gate_hi"))).alias("__rows")
    )
    before = "element_at(__a, -1)"
    gate = f"(greatest(__r.`{weight}`, {before}.w) >= {jump} or abs(__r.`{weight}` - {before}.w) >= {jump})"
    lo, hi = f"if({gate}, __r.gate_lo, __r.normal_lo)", f"if({gate}, __r.gate_hi, __r.normal_hi)"
    step = f"{before}.v + greatest(least(__r.`{pred}` - {before}.v, {hi}), {lo})"
    # an empty entry stands before the day's first slot, which has no step to hold
    folded = F.expr(f"""aggregate(
        __rows,
        array(struct(double(null) as v, double(null) as w)),
        (__a, __r) -> array_append(__a, struct(
            if({before}.v is null, double(__r.`{pred}`), {step}) as v, double(__r.`{weight}`) as w)),
        __a -> slice(__a.v, 2, {SLOTS}))""")
    carried = ", ".join(f"__r.`{c}` as `{c}`" for c in ["cycle", *rest])
    zipped = F.expr(f"transform(__rows, (__r, __i) -> struct({carried}, __held[__i] as `{out}`))")
    return packed.withColumn("__held", folded).select("series_id", "date", F.inline(zipped)).select(*cols, out)


def guard_helps(df: DataFrame, y: str = "y", raw: str = "pred", guarded: str = "guarded", slack: float = 1.0, limits: Limits = Limits()) -> DataFrame:
    """Per series: whether the guard costs at most ``slack`` of error, clean and overall."""
    clean = is_clean(y, limits)

    def mae(c: str, cond=None):
        e = F.abs(F.col(y) - F.col(c))
        return F.avg(e if cond is None else F.when(cond, e))

    return df.groupBy("series_id").agg(
        mae(raw).alias("raw_mae"), mae(guarded).alias("guarded_mae"),
        mae(raw, clean).alias("raw_clean_mae"), mae(guarded, clean).alias("guarded_clean_mae"),
    ).withColumn(
        "guard_on",
        (F.col("guarded_clean_mae") <= F.col("raw_clean_mae") + slack) & (F.col("guarded_mae") <= F.col("raw_mae") + slack),
    )
