"""Leaf values of boosted trees as medians of residuals.

A booster of absolute errors fits signs, so its leaves hold mean signs: a tree moves a forecast by one step whatever
the error is. `refit` keeps the splits and fits the values again. Rows are keyed by their leaf in
every tree. For a block of trees, the weighted median residual of each leaf is found, all of them move by
one common part of it, and the part with the least error is taken, 0 among them: no block raises the error it
is chosen by. That is the training rows' error, or that of held-out rows where there are some.

Medians come from histograms: weights summed by (tree, leaf, bin) before anything is shuffled, so a leaf
that holds all rows is no more than `BINS_A_SIDE` times two rows. Bins are even in asinh of the residual: near 0 they are
`FINE` wide, far away a 64th of the residual. Leaf values are a small table (tree, leaf, value) bounded by the
settings of the learner.
"""

import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINE = 1e-4
BINS_PER_UNIT = 64
BINS_A_SIDE = 2048
PARTS = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def _table(values: list[list[float]]) -> Column:
    """All leaf values as one constant: a list per tree."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<double>>")


def summed(leaves: Column, values: list[list[float]]) -> Column:
    """Sum over all trees of the value of the row's leaf."""
    table = _table(values)
    found = F.transform(leaves, lambda leaf, t: F.get(F.get(table, t), leaf))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + x)


class LeafValues(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Forecast from the leaves of an ensemble, in the target's unit; saved and loaded with its pipeline."""

    leavesCol = Param(Params._dummy(), "leavesCol", "leaf of every tree", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "forecast", TypeConverters.toString)
    values = Param(Params._dummy(), "values", "leaf values as JSON, a list per tree", TypeConverters.toString)
    center = Param(Params._dummy(), "center", "added last", TypeConverters.toFloat)
    spread = Param(Params._dummy(), "spread", "unit of the values", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, leavesCol="__leaves", outputCol="pred", values="[]", center=0.0, spread=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def by_tree(self) -> list[list[float]]:
        return json.loads(self.getOrDefault(self.values))

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, leaf, value) in the target's unit."""
        spread = self.getOrDefault(self.spread)
        rows = [(t, i, v * spread) for t, vs in enumerate(self.by_tree()) for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "tree int, leaf int, value double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        leaves = leaf_array(self.getOrDefault(self.leavesCol))
        total = summed(leaves, self.by_tree()) * self.getOrDefault(self.spread) + self.getOrDefault(self.center)
        return dataset.withColumn(self.getOrDefault(self.outputCol), total)


def leaf_array(vector: str) -> Column:
    return vector_to_array(vector).cast("array<int>")


def plain_values(model) -> list[list[float]]:
    """The ensemble's own leaf values times its steps, by tree and leaf number (left leaf first)."""
    out = []
    for tree, step in zip(model.trees, model.treeWeights):
        found = [line.split("Predict:")[1] for line in tree.toDebugString.splitlines() if "Predict:" in line]
        out.append([float(v) * step for v in found])
    return out


def medians(rows: DataFrame, block: range) -> DataFrame:
    """(tree, leaf, median): weighted median of `r` in every leaf of the trees of `block`; rows have leaves, r, weight."""
    picked = F.array(*[F.struct(F.lit(t).alias("tree"), F.get("leaves", F.lit(t)).alias("leaf")) for t in block])
    side = F.asinh(F.abs("r") / FINE) * BINS_PER_UNIT
    # 0 is a bin of its own; asinh of 2048 bins reaches residuals of 4e9 units
    number = F.least(F.round(side), F.lit(float(BINS_A_SIDE))) * F.signum("r")
    long = rows.select(F.explode(picked).alias("at"), number.cast("int").alias("bin"), "weight")
    hist = long.groupBy("at.tree", "at.leaf", "bin").agg(F.sum("weight").alias("w"))
    group = Window.partitionBy("tree", "leaf")
    run = hist.withColumn("below", F.sum("w").over(group.orderBy("bin"))).withColumn("total", F.sum("w").over(group))
    first = run.where("below >= total / 2").groupBy("tree", "leaf").agg(F.min("bin").alias("bin"))
    value = F.signum(F.col("bin").cast("double")) * F.sinh(F.abs("bin") / BINS_PER_UNIT) * FINE
    return first.select("tree", "leaf", value.alias("median"))


def refit(rows: DataFrame, values: list[list[float]], block: int, some_held: bool = False) -> list[list[float]]:
    """New leaf values, block after block of trees. ``rows`` have y, weight, leaves (array) and held.

    With ``some_held`` the held rows judge, where there are any; they are never trained on.
    """
    values = [list(v) for v in values]
    judge = F.col("held") if some_held and not rows.where("held").isEmpty() else F.lit(True)
    for start in range(0, len(values), block):
        trees = range(start, min(start + block, len(values)))
        placed = rows.withColumn("r", F.col("y") - summed(F.col("leaves"), values))
        moves = [[0.0] * len(v) if t in trees else [] for t, v in enumerate(values)]
        for tree, leaf, median in medians(placed.where("not held"), trees).collect():
            moves[tree][leaf] = median
        move = summed(F.slice("leaves", start + 1, len(trees)), moves[start : trees.stop])
        errors = [F.sum(F.when(judge, F.col("weight") * F.abs(F.col("r") - F.lit(p) * F.col("move")))) for p in PARTS]
        found = placed.withColumn("move", move).agg(*errors).first()
        best = min(range(len(PARTS)), key=lambda i: (found[i] if found[i] is not None else 0.0, i))
        for t in trees:
            values[t] = [v + PARTS[best] * m for v, m in zip(values[t], moves[t])]
    return values
