"""Null-safe numeric helpers. Missing is always NULL, never NaN."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and +-Inf become NULL."""
    if isinstance(c, str):
        return F.expr(finite_sql(c))
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_sql(name: str) -> str:
    """``finite`` of a named column as SQL text: one call per column when there are hundreds."""
    c = f"double(`{name}`)"
    return f"case when not isnan({c}) and abs({c}) != double('Infinity') then {c} end"


def finite_columns(df: DataFrame) -> DataFrame:
    """``finite`` on every floating column of ``df``, in one projection."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.selectExpr(*[f"{finite_sql(c)} as `{c}`" if c in floating else f"`{c}`" for c in df.columns])


def clip(c, low: float, high: float) -> Column:
    """Clip that keeps NULL as NULL (``least``/``greatest`` alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending, null-free array."""
    pos = (F.size(values) - 1) * F.lit(q)
    lower = F.get(values, F.floor(pos).cast("int"))
    upper = F.get(values, F.ceil(pos).cast("int"))
    return lower + (upper - lower) * (pos - F.floor(pos))


def row_median(cols) -> Column:
    """Median across columns of one row, missing values skipped."""
    present = F.filter(F.array(*[as_col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return sorted_quantile(F.array_sort(present), 0.5)


def row_sum(cols) -> Column:
    """Sum across columns of one row, missing counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in cols])


def dot(cols, weights) -> Column:
    """Weighted sum across columns."""
    return reduce(lambda a, b: a + b, [as_col(c) * as_col(w) for c, w in zip(cols, weights)])
