"""Linear blend of base forecasts with an L2 penalty, chosen by chronological validation.

The fit only needs sums of products of the forecasts. One aggregation yields them per
series and fold; a training set is a running sum of folds, and solving it is a system
of as many unknowns as there are models. Candidates are scored in one further pass.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.regime import is_clean
from slotcast.limits import Limits
from slotcast.sources.shared import settle

# fixed values: 20 penalties, log-spaced from 1e-2 to 1e5
ALPHAS = tuple(float(a) for a in np.logspace(-2, 5, 20))


def moments(df: DataFrame, models: list[str], y: str, by: list[str]) -> DataFrame:
    """Count, sums and sums of products of the models and the target."""
    cols = [*models, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(c) for c in cols]).alias("sums"),
        F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).alias("products"),
    )


def _solve(n: float, sums: np.ndarray, products: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with free intercept from moments: intercept first, then one weight per model."""
    k = len(sums)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = products
    full = full + np.triu(full, 1).T
    mean = sums / n
    cov = full - n * np.outer(mean, mean)
    w = np.linalg.solve(cov[:-1, :-1] + alpha * np.eye(k - 1), cov[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def fit_grid(folds: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Per series, fold and penalty: the blend trained on all earlier folds; fold 0 of the result trains on all.

    Input groups are one row of moments per fold.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fold")
        rows = []
        n, sums, prods = 0.0, 0.0, 0.0
        for r in [*pdf.itertuples(index=False), None]:
            if n:
                fold = 0 if r is None else int(r.fold)
                rows += [(pdf["series_id"].iloc[0], fold, a, _solve(n, sums, prods, a).tolist()) for a in alphas]
            if r is not None:
                n, sums, prods = n + r.n, sums + np.asarray(r.sums), prods + np.asarray(r.products)
        return pd.DataFrame(rows, columns=["series_id", "fold", "alpha", "coef"])

    return folds.groupBy("series_id").applyInPandas(solve, "series_id string, fold int, alpha double, coef array<double>")


def apply_blend(df: DataFrame, coef: str, models: list[str], out: str) -> DataFrame:
    """A model without weight does not matter, also where it has no forecast."""
    value = F.get(coef, F.lit(0))
    for i, m in enumerate(models):
        weight = F.get(coef, F.lit(i + 1))
        value = value + F.when(weight == 0, 0.0).otherwise(weight * F.col(m))
    return df.withColumn(out, value)


def fresh_folds(df: DataFrame, n: int = 5, order: str = "date") -> DataFrame:
    """``fold``: the days of each series cut into n + 1 equal stretches, 0 the first, which only trains."""
    span = df.groupBy("series_id").agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    pos = F.datediff(F.col(order), F.col("__a")) / (F.datediff("__b", "__a") + 1)
    return df.drop("fold").join(span, "series_id").withColumn("fold", F.floor(pos * (n + 1)).cast("int")).drop("__a", "__b")


def ridge_blend(df: DataFrame, models: list[str], y: str = "y", alphas=ALPHAS) -> DataFrame:
    """Per series: the penalty of least absolute error over the folds, and its weights on all rows.

    ``df`` carries ``fold``, 0 for rows that only train. Fold errors count equally. All
    penalties of a row are scored as array elements, so rows are not multiplied.
    """
    grid = fit_grid(moments(df, models, y, ["series_id", "fold"]), alphas)
    by_fold = grid.groupBy("series_id", "fold").agg(
        F.array_sort(F.collect_list(F.struct("alpha", "coef"))).alias("cands")
    )
    point = " + ".join(["__c.coef[0]", *[f"__c.coef[{i + 1}] * `{m}`" for i, m in enumerate(models)]])
    errors = df.join(by_fold.where("fold > 0"), ["series_id", "fold"]).withColumn(
        "__e", F.expr(f"transform(cands, __c -> abs(`{y}` - ({point})))")
    )
    maes = F.array(*[F.avg(F.get("__e", F.lit(i))) for i in range(len(alphas))])
    per_fold = errors.groupBy("series_id", "fold").agg(maes.alias("m")).select(
        "series_id", F.posexplode("m").alias("i", "mae")
    )
    scored = per_fold.groupBy("series_id", "i").agg(F.avg("mae").alias("mae"))
    best = scored.groupBy("series_id").agg(F.min_by("i", F.struct("mae", "i")).alias("i"), F.min("mae").alias("cv_mae"))
    final = by_fold.where("fold = 0").select("series_id", "cands")
    chosen = F.get("cands", F.col("i"))
    return final.join(best, "series_id").select("series_id", chosen["alpha"].alias("alpha"), chosen["coef"].alias("coef"), "cv_mae")


def choose_models(
    df: DataFrame, candidates: dict[str, list[str]], order: str = "date", share: float = 0.8, y: str = "y",
    n_folds: int = 5, limits: Limits = Limits(),
) -> DataFrame:
    """Per series and candidate set: clean error on the last ``1 - share`` of days of a blend trained before.

    Returns ``series_id, candidate, score, chosen``.
    """
    span = df.groupBy("series_id").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    pos = F.datediff(F.col(order), F.col("a")) / F.greatest(F.datediff("b", "a") + 1, F.lit(1))
    placed = settle(df.join(span, "series_id").withColumn("__pos", pos), "blend")
    clean = placed.where(is_clean(y, limits))
    train = clean.where(F.col("__pos") < share).withColumn(
        "fold", F.floor(F.col("__pos") / share * (n_folds + 1)).cast("int")
    )
    test = clean.where(F.col("__pos") >= share)
    scores = None
    for name, models in candidates.items():
        fitted = ridge_blend(train, models, y).select("series_id", "coef")
        s = apply_blend(test.join(fitted, "series_id"), "coef", models, "__b")
        s = s.groupBy("series_id").agg(F.avg(F.abs(F.col(y) - F.col("__b"))).alias("score"))
        s = s.select("series_id", F.lit(name).alias("candidate"), "score")
        scores = s if scores is None else scores.unionByName(s)
    best = scores.groupBy("series_id").agg(F.min_by("candidate", F.struct("score", "candidate")).alias("best"))
    return scores.join(best, "series_id").withColumn("chosen", F.col("candidate") == F.col("best")).drop("best")
