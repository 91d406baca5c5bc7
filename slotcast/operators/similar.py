"""Forecast a day from the most similar past days of its series.

Exact nearest neighbours: days are packed into blocks of a fixed number of days. A group is one
block of query days with all training blocks of its series, so a series is spread over as many
tasks as it has query blocks, a query block is sent once, and distances are taken block by block.
The size of a group is bounded by the calendar: one vector per day of one series.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.operators import daily

NEIGHBOURS = 21
BLOCK_DAYS = 64


def pack_days(days: DataFrame, prefix: str, vector: str, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Day vectors grouped into calendar blocks of ``block_days``: day numbers and one flat array."""
    day = F.unix_date("date")
    rows = F.array_sort(F.collect_list(F.struct(day.alias("d"), F.col(vector).alias("v"))))
    packed = days.groupBy("series_id", F.floor(day / block_days).alias(f"{prefix}_block")).agg(rows.alias("r"))
    return packed.select(
        "series_id", f"{prefix}_block",
        F.transform("r", lambda x: x["d"]).alias(f"{prefix}_days"),
        F.flatten(F.transform("r", lambda x: x["v"])).alias(f"{prefix}_flat"),
    )


def nearest_days(train: DataFrame, query: DataFrame, k: int = NEIGHBOURS, vector: str = "features", block_days: int = BLOCK_DAYS) -> DataFrame:
    """``(series_id, date, near_date, distance, rank)``: the k training days closest to each query day.

    Distance is the mean squared difference; ties go to the earlier day.
    """
    asked = pack_days(query, "q", vector, block_days)
    places = asked.select(F.col("series_id").alias("s"), F.col("q_block").alias("b"))
    packed = pack_days(train, "t", vector, block_days)
    known = places.join(packed, places["s"] == packed["series_id"]).select("s", "b", "t_days", "t_flat")

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["series_id", "d", "near", "distance", "rank"])
        if asked.empty or known.empty:
            return empty
        q_days = np.concatenate(asked["q_days"].to_list())
        q = np.concatenate(asked["q_flat"].to_list()).astype(float).reshape(len(q_days), -1)
        days, parts = [], []
        for t_days, flat in zip(known["t_days"], known["t_flat"]):
            t = np.asarray(flat, dtype=float).reshape(len(t_days), -1)
            parts.append(np.stack([((t - vec) ** 2).mean(axis=1) for vec in q]))
            days.append(np.asarray(t_days))
        days, dist = np.concatenate(days), np.concatenate(parts, axis=1)
        order = np.lexsort((np.broadcast_to(days, dist.shape), dist), axis=1)[:, :k]
        n = order.shape[1]
        return pd.DataFrame({
            "series_id": asked["series_id"].iloc[0], "d": np.repeat(q_days, n), "near": days[order].ravel(),
            "distance": np.take_along_axis(dist, order, axis=1).ravel(), "rank": np.tile(np.arange(1, n + 1), len(q_days)),
        })

    ranked = asked.groupBy("series_id", "q_block").cogroup(known.groupBy("s", "b")).applyInPandas(
        best, "series_id string, d int, near int, distance double, rank int"
    )
    return ranked.select(
        "series_id", F.date_from_unix_date("d").alias("date"), F.date_from_unix_date("near").alias("near_date"), "distance", "rank"
    )


def kernel_weights(near: DataFrame) -> DataFrame:
    """``exp(-distance / median distance)`` of each query day's neighbours, summing to 1."""
    by_query = Window.partitionBy("series_id", "date")
    raw = F.exp(-F.col("distance") / (F.expr("percentile(distance, 0.5)").over(by_query) + 1e-9))
    staged = near.withColumn("__w", raw)
    return staged.withColumn("weight", F.col("__w") / F.sum("__w").over(by_query)).drop("__w")


def weighted_profile(near: DataFrame, targets: DataFrame) -> DataFrame:
    """Kernel-weighted mean of the neighbours' 48 values, as rows ``(series_id, date, cycle, pred)``."""
    by_near = targets.select("series_id", F.col("date").alias("near_date"), "targets")
    slots = near.join(by_near, ["series_id", "near_date"]).select(
        "series_id", "date", "weight", F.posexplode("targets").alias("cycle", "v")
    )
    mean = F.sum(F.col("weight") * F.col("v")) / F.sum("weight")
    return slots.groupBy("series_id", "date", "cycle").agg(mean.alias("pred"))


def similar_days(
    train: DataFrame, query: DataFrame, profile: list[str], scalar: list[str] = [], y: str = "y", k: int = NEIGHBOURS,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Forecast every slot of the query days from the panel rows in ``train``."""
    targets = daily.daily_targets(train, y)
    fitted = daily.training_days(daily.daily_matrix(train, profile, scalar), targets)
    params = daily.robust_params(fitted, "features")
    near = nearest_days(
        daily.scale_days(fitted, params).drop("targets"),
        daily.scale_days(daily.daily_matrix(query, profile, scalar), params),
        k, "features", block_days,
    )
    return weighted_profile(kernel_weights(near), targets)
