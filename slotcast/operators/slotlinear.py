"""Sparse linear forecast of a whole day, all 48 slots at once, fitted from sums of products.

Members are fits over trailing windows of days, each with a penalty chosen on its newest days. All of those fits need
the same sums over different days. A day belongs to some of the fits; days of the same fits are
summed in chunks of `CHUNK` days, tile by tile of the product matrix, and chunks are added up per fit by
Spark. So no task sees a series' days together, and what is solved is one matrix per fit, whose size is that of the
features, whatever the number of days. Fits of all series, windows and penalties are solved in parallel, a row each.
Penalties are compared, members weighted and forecasts made by joins and array expressions.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.limits import SLOTS
from slotcast.operators import daily
from slotcast.sources.shared import drop_tables, settle

CHUNK = 64
TILE = 64
LOW, HIGH = 0.1, 0.9
FLAT = 1e-6


def shrink(gram: np.ndarray, corr: np.ndarray, alpha: float, steps: int = 2000, tol: float = 1e-6) -> np.ndarray:
    """Weights for covariances of the features, and of features and targets, with a penalty on each feature's row of weights.

    A feature is kept for all slots or dropped for all. Accelerated proximal gradient, restarted when it overshoots.
    """
    rate = 1.0 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = np.zeros_like(corr)
    ahead, pace = w, 1.0
    for _ in range(steps):
        moved = ahead - rate * (gram @ ahead - corr)
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        new = moved * np.maximum(0.0, 1.0 - rate * alpha / np.maximum(size, 1e-300))
        step = new - w
        if np.abs(step).max() < tol * max(1.0, np.abs(new).max()):
            return new
        if ((ahead - new) * step).sum() > 0:
            pace = 1.0
        faster = (1.0 + np.sqrt(1.0 + 4.0 * pace * pace)) / 2.0
        ahead, w, pace = new + (pace - 1.0) / faster * step, new, faster
    return w


def shrink_rows(x: np.ndarray, y: np.ndarray, alpha: float, **kw) -> np.ndarray:
    """`shrink` for centred columns of features and targets."""
    return shrink(x.T @ x / len(x), x.T @ y / len(x), alpha, **kw)


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Products of (1, features) with (1, features, targets), summed over a chunk of days, in tiles of rows."""
    z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["z"])])
    sums = z[:, :-SLOTS].T @ z
    tiles = [sums[i : i + TILE].ravel() for i in range(0, len(sums), TILE)]
    return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "fits": pdf["fits"].iloc[0], "tile": range(len(tiles)), "sums": tiles})


def _solve(tiles: list[np.ndarray], center: np.ndarray, scale: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots by features) and intercepts of one fit, in the original units."""
    width = len(center) + 1
    sums = np.concatenate([np.asarray(t).reshape(-1, width) for t in tiles])
    n, p = sums[0, 0], len(sums) - 1
    mean = sums[0, 1:] / n
    cov = (sums[1:, 1:] / n - np.outer(mean[:p], mean)) / np.outer(scale[:p], scale)
    coef = shrink(cov[:, :p], cov[:, p:], alpha) / scale[:p, None] * scale[p:]
    return coef.T, mean[p:] + center[p:] - (mean[:p] + center[:p]) @ coef


def _solved(batches):
    """A solved fit per row of series_id, fit, alpha, tiles, center, scale."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: c[at] for n, c in zip(batch.schema.names, batch.columns)}
            tiles = [np.asarray(t["sums"].values) for t in sorted(row["tiles"], key=lambda t: t["tile"].as_py())]
            coef, intercept = _solve(tiles, np.asarray(row["center"].values), np.asarray(row["scale"].values), row["alpha"].as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["series_id"].as_py()]), pa.array([row["fit"].as_py()], pa.int32()), pa.array([row["alpha"].as_py()]),
                    pa.array([coef.tolist()], pa.list_(pa.list_(pa.float64()))), pa.array([intercept.tolist()], pa.list_(pa.float64())),
                ],
                names=["series_id", "fit", "alpha", "coef", "intercept"],
            )


def dot_slots(features: str, coef: str, intercept: str) -> Column:
    """The 48 forecasts of a day."""
    products = f"zip_with({features}, __c, (__x, __w) -> __x * __w)"
    return F.expr(f"zip_with({coef}, {intercept}, (__c, __b) -> __b + aggregate({products}, 0D, (__s, __v) -> __s + __v))")


def _added(rows: DataFrame, by: list[str], *arrays: str, nested: tuple = ()) -> DataFrame:
    """Arrays of a group added up element by element."""
    plain = "aggregate(slice({0}, 2, size({0})), {0}[0], (a, x) -> zip_with(a, x, (u, v) -> u + v))"
    deep = "aggregate(slice({0}, 2, size({0})), {0}[0], (a, x) -> zip_with(a, x, (s, t) -> zip_with(s, t, (u, v) -> u + v)))"
    packed = rows.groupBy(*by).agg(*[F.collect_list(a).alias(a) for a in (*arrays, *nested)])
    return packed.select(*by, *[F.expr(plain.format(a)).alias(a) for a in arrays], *[F.expr(deep.format(a)).alias(a) for a in nested])


@dataclass
class SlotLinear:
    """Members over trailing windows of days, weighted by the inverse of their hold-out error.

    ``windows`` are day counts, None is all days. Each member picks its penalty on the
    last sixth of its days, 28 to 84 of them, and is refitted on all of them.
    """

    windows: tuple = (365, None)
    alphas: tuple = (0.001, 0.003)
    min_days: int = 120
    holdout: tuple = (28, 84)
    model: DataFrame | None = None

    def _members(self) -> list[tuple[Column, Column, Column]]:
        """Per window, from a series' number of days: whether it counts, its days, and how many of them are held out."""
        out, taken = [], []
        for window in self.windows:
            n = F.col("days") if window is None else F.least(F.col("days"), F.lit(window))
            counts = reduce(lambda a, b: a & b, [n != t for t in taken], n >= self.min_days)
            lo, hi = self.holdout
            out.append((counts, n, F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(n / 6)))))
            taken.append(n)
        return out

    def _placed(self, days: DataFrame) -> DataFrame:
        """Days with ``z`` (features, then targets), the bits of the ``fits`` they are in and of the windows they are ``held`` out of.

        Fit 2i is window i without its held-out days, fit 2i + 1 all of window i.
        """
        series = Window.partitionBy("series_id")
        ranked = days.select(
            "series_id", "date", F.concat("features", "targets").alias("z"), F.count("*").over(series).alias("days"),
            (F.row_number().over(series.orderBy(F.desc("date"))) - 1).alias("age"),
        )
        fits, held = F.lit(0), F.lit(0)
        for i, (counts, n, out) in enumerate(self._members()):
            inside = counts & (F.col("age") < n)
            fits = fits + F.when(inside & (F.col("age") >= out), 1 << 2 * i).otherwise(0) + F.when(inside, 2 << 2 * i).otherwise(0)
            held = held + F.when(inside & (F.col("age") < out), 1 << i).otherwise(0)
        return ranked.select("series_id", "date", "z", "age", fits.alias("fits"), held.alias("held")).where("fits > 0")

    def _scales(self, placed: DataFrame) -> DataFrame:
        """Per series and fit: ``center`` of every position over all days, and the spread between its quantiles in the fit."""
        fits = range(2 * len(self.windows))
        long = placed.select("series_id", "fits", F.size("z").alias("size"), F.posexplode("z").alias("pos", "v"))
        quantiles = [F.percentile(F.when(F.col("fits").bitwiseAND(F.lit(1 << f)) > 0, F.col("v")), F.array(F.lit(LOW), F.lit(HIGH))).alias(f"q{f}") for f in fits]
        found = long.groupBy("series_id", "pos", "size").agg(F.avg("v").alias("center"), *quantiles)
        spreads = [
            F.struct(F.lit(f).alias("fit"), (F.col(f"q{f}")[1] - F.col(f"q{f}")[0]).alias("spread")) for f in fits
        ]
        rows = found.select("series_id", "pos", "size", "center", F.inline(F.array(*spreads))).where("spread is not null")
        floor = F.when(F.col("pos") < F.col("size") - SLOTS, 0.0).otherwise(FLAT)
        scaled = rows.withColumn("scale", F.when(F.col("spread") > floor, F.col("spread")).otherwise(1.0))
        packed = scaled.groupBy("series_id", "fit").agg(F.array_sort(F.collect_list(F.struct("pos", "center", "scale"))).alias("p"))
        return packed.select("series_id", "fit", F.col("p.center").alias("center"), F.col("p.scale").alias("scale"))

    def _sums(self, placed: DataFrame, scales: DataFrame) -> DataFrame:
        """Per series and fit: the summed products of centred days, as ``tiles``."""
        centers = scales.groupBy("series_id").agg(F.min_by("center", "fit").alias("center"))
        centred = placed.join(centers, "series_id").select(
            "series_id", "fits", F.floor(F.col("age") / CHUNK).alias("chunk"), F.zip_with("z", "center", lambda a, b: a - b).alias("z")
        )
        chunks = centred.groupBy("series_id", "fits", "chunk").applyInPandas(_products, "series_id string, fits int, tile int, sums array<double>")
        members = F.array(*[F.when(F.col("fits").bitwiseAND(F.lit(1 << f)) > 0, F.lit(f)) for f in range(2 * len(self.windows))])
        per_fit = chunks.withColumn("fit", F.explode(F.filter(members, lambda f: f.isNotNull()))).drop("fits")
        added = _added(per_fit, ["series_id", "fit", "tile"], "sums")
        return added.groupBy("series_id", "fit").agg(F.collect_list(F.struct("tile", "sums")).alias("tiles"))

    def _solve_fits(self, fits: DataFrame) -> DataFrame:
        """``fits`` are rows of tiles, center, scale and alpha."""
        parts = int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = fits.select("series_id", "fit", "alpha", "tiles", "center", "scale").repartition(parts, "series_id", "fit", "alpha")
        return spread.mapInArrow(_solved, "series_id string, fit int, alpha double, coef array<array<double>>, intercept array<double>")

    def fit(self, days: DataFrame) -> "SlotLinear":
        """``days`` has ``features`` and ``targets``. A series with too few days gets no model."""
        paths: list[str] = []
        placed = settle(self._placed(days), "linear-days", paths)
        scales = settle(self._scales(placed), "linear-scales", paths)
        stats = settle(self._sums(placed, scales).join(scales, ["series_id", "fit"]), "linear-sums", paths)
        penalties = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(i).alias("place")) for i, a in enumerate(self.alphas)]))
        probes = self._solve_fits(stats.where("fit % 2 = 0").withColumn("p", penalties).withColumn("alpha", F.col("p.alpha")))
        tests = placed.where("held > 0").select(
            "series_id", "held", F.expr(f"slice(z, 1, size(z) - {SLOTS})").alias("features"), F.expr(f"slice(z, size(z) - {SLOTS - 1}, {SLOTS})").alias("targets")
        )
        tried = tests.join(probes.withColumn("window", F.expr("fit div 2")), "series_id").where("held & shiftleft(1, int(window)) > 0")
        off = F.aggregate(F.zip_with("targets", dot_slots("features", "coef", "intercept"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
        errors = tried.groupBy("series_id", "window", "alpha").agg((F.sum(off) / (F.count("*") * SLOTS)).alias("error"))
        place = F.array_position(F.array(*[F.lit(float(a)) for a in self.alphas]), F.col("alpha"))
        best = errors.groupBy("series_id", "window").agg(
            F.min_by("alpha", F.struct("error", place)).alias("alpha"), F.greatest(F.min("error"), F.lit(FLAT)).alias("error")
        )
        best = settle(best.withColumn("fit", (F.col("window") * 2 + 1).cast("int")), "linear-best", paths)
        members = settle(self._solve_fits(stats.join(best.select("series_id", "fit", "alpha"), ["series_id", "fit"])), "linear-members", paths)
        share = (1 / F.col("error")) / F.sum(1 / F.col("error")).over(Window.partitionBy("series_id"))
        weighed = members.join(best.withColumn("share", share).select("series_id", "fit", "share"), ["series_id", "fit"]).select(
            "series_id",
            F.expr("transform(coef, __c -> transform(__c, __w -> __w * share))").alias("coef"),
            F.expr("transform(intercept, __b -> __b * share)").alias("intercept"),
        )
        chosen = best.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("window", "alpha", "error"))).alias("m"))
        described = chosen.select("series_id", F.size("m").alias("members"), F.col("m.alpha").alias("alphas"), F.col("m.error").alias("errors"))
        self.model = settle(described.join(_added(weighed, ["series_id"], "intercept", nested=("coef",)), "series_id"), "slot-linear")
        drop_tables(days.sparkSession, paths)
        return self

    def transform(self, days: DataFrame) -> DataFrame:
        """``targets``: the 48 forecasts of each day of ``days``, for series that have a model."""
        joined = days.select("series_id", "date", "features").join(self.model.select("series_id", "coef", "intercept"), "series_id")
        return joined.select("series_id", "date", dot_slots("features", "coef", "intercept").alias("targets"))


def fit_panel(df: DataFrame, profile: list[str], scalar: list[str] = [], y: str = "y", **kw) -> SlotLinear:
    """Daily matrix and targets from panel rows, then the fit."""
    days = daily.training_days(daily.daily_matrix(df, profile, scalar), daily.daily_targets(df, y))
    return SlotLinear(**kw).fit(days)


def predict_panel(model: SlotLinear, df: DataFrame, profile: list[str], scalar: list[str] = [], out: str = "pred") -> DataFrame:
    """One forecast per panel row."""
    return daily.rows_from_daily(df, model.transform(daily.daily_matrix(df, profile, scalar)), "targets", out)
