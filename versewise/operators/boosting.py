"""Multinomial gradient boosting over Spark ML regression trees (M2).

One model for all classes with one loss, the multinomial log loss: in each
round every class gets a regression tree fitted to the gradients of that loss
(y_k - p_k, p the softmax of the margins so far), and each leaf takes the Newton
step of its rows, (K-1)/K sum g / sum |g| (1 - |g|) (Friedman 2001). The classes'
trees of a round are fitted by Spark at the same time. Margins are kept with the
rows, so that a round costs the same whenever it comes; every ``checkpoint``
rounds they are written, which cuts the lineage.

Rows marked as validation don't train: they tell when to stop, after
``patience`` rounds that don't lower their log loss, and the model keeps the
rounds up to the best. So the number of rounds is an upper bound.

A fitted model is a table of trees, at most rounds x classes x 2^(depth+1)
nodes, walked in Arrow batches, a level of all rows of a batch at a time.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.session import stage_table

#: Rounds without a lower validation loss before fitting stops; least gain that counts.
PATIENCE, LEAST_GAIN = 5, 1e-4
CHECKPOINT = 10


def tree_arrays(java_root) -> dict[str, list]:
    """A fitted tree as lists over its nodes: feature (-1 in a leaf),
    threshold (left if not above), left and right."""
    feature, threshold, left, right = [], [], [], []

    def add(node) -> int:
        at = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(at)
        right.append(at)
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[at], threshold[at] = split.featureIndex(), split.threshold()
            left[at] = add(node.leftChild())
            right[at] = add(node.rightChild())
        return at

    add(java_root)
    return {"feature": feature, "threshold": threshold, "left": left, "right": right}


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``x`` falls into."""
    feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
    left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while (feature[at] >= 0).any():
        f = feature[at]
        inner = f >= 0
        go_left = x[rows, np.maximum(f, 0)] <= threshold[at]
        at = np.where(inner, np.where(go_left, left[at], right[at]), at)
    return at


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def number(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


class BoostedClasses:
    """A fitted classifier: feature names, their means and deviations, class
    names, prior margins and rounds of one tree a class with leaf values."""

    def __init__(self, features: list[str], mean: list[float], std: list[float], classes: list[str], prior: list[float],
                 rounds: list[list[dict]], losses: list[float]):
        self.features, self.mean, self.std, self.classes = features, mean, std, classes
        self.prior, self.rounds, self.losses = prior, rounds, losses

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "BoostedClasses":
        return cls(**json.loads(text))

    def scaled(self) -> Column:
        """The features as an array of scaled doubles; a missing one (NULL or
        NaN) counts as the mean, 0."""
        return F.array(*[F.coalesce((number(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0), F.lit(0.0))
                         for c, m, s in zip(self.features, self.mean, self.std)])

    def probabilities(self) -> Column:
        """Class probabilities of each row, in the order of ``classes``."""
        prior, rounds, width = np.array(self.prior), self.rounds, len(self.features)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            m = matrix(x, width)
            margins = np.tile(prior, (len(m), 1))
            for trees in rounds:
                for k, t in enumerate(trees):
                    margins[:, k] += np.asarray(t["value"])[leaves(t, m)]
            return pd.Series(list(softmax(margins)))

        return run(self.scaled())

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.classes])
        df = df.withColumn(probability, self.probabilities())
        best = F.array_position(F.col(probability), F.array_max(probability)).cast("int")
        return df.withColumn(prediction, F.element_at(names, best))


def fit(train: DataFrame, features: list[str], label: str, rounds: int, depth: int, rate: float, seed: int = 42,
        validation: str | None = None, patience: int = PATIENCE, checkpoint: int = CHECKPOINT, parallelism: int = 8,
        max_bins: int = 32) -> BoostedClasses:
    """Fit on the rows of ``train`` whose ``label`` isn't null. ``validation``:
    a boolean column; rows where it is true only tell when to stop."""
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    rows = train.filter(F.col(label).isNotNull()).withColumns({"_label": F.col(label).cast("string"), "_held": held})
    counts = {r["_label"]: r["n"] for r in rows.filter("NOT _held").groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled rows to fit the classes on")
    classes = sorted(counts)
    total, n_classes = sum(counts.values()), len(classes)
    prior = [math.log(counts[c] / total) for c in classes]
    got = rows.filter("NOT _held").agg(*[f(number(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_samp)]).first()
    mean, std = [[float(got[f"{f}{i}"] or 0.0) for i in range(len(features))] for f in ("avg", "stddev_samp")]
    model = BoostedClasses(features, mean, std, classes, prior, [], [])
    # a held row of a class that isn't trained has no place among the classes (-1) and tells nothing
    y = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_label")).cast("int"), F.lit(0)) - 1
    state = stage_table(rows.select(array_to_vector(model.scaled()).alias("x"), y.alias("y"), F.col("_held").alias("held"),
                                    F.array(*[F.lit(p) for p in prior]).alias("margins")).filter("y >= 0"), "boost")
    stop_at, best = 0, math.inf
    for m in range(rounds):
        gradients = state.withColumn("g", _gradients(n_classes)("margins", "y"))
        train_rows = gradients.filter("NOT held").select("x", *[F.col("g")[k].alias(f"g{k}") for k in range(n_classes)]).persist(StorageLevel.MEMORY_AND_DISK)
        train_rows.count()

        def tree(k: int) -> dict:
            fitted = DecisionTreeRegressor(featuresCol="x", labelCol=f"g{k}", maxDepth=depth, maxBins=max_bins, seed=seed + m,
                                           cacheNodeIds=depth > 5, checkpointInterval=CHECKPOINT).fit(train_rows)
            return tree_arrays(fitted._java_obj.rootNode())

        with ThreadPoolExecutor(min(parallelism, n_classes)) as pool:
            trees = list(pool.map(tree, range(n_classes)))
        _newton_values(train_rows, trees, rate)
        train_rows.unpersist()
        model.rounds.append(trees)
        new = state.withColumn("margins", _moved(trees)("margins", "x"))
        if (m + 1) % checkpoint == 0:
            new = stage_table(new, "boost")
        else:
            new = new.persist(StorageLevel.MEMORY_AND_DISK)
        loss = new.groupBy("held").agg(F.avg(_loss("margins", "y")).alias("loss")).collect()
        state.unpersist()
        state = new
        by = {r["held"]: r["loss"] for r in loss}
        now = by.get(True, by.get(False, 0.0))
        model.losses.append(float(now))
        if now < best - LEAST_GAIN:
            stop_at, best = m + 1, now
        elif validation and m + 1 - stop_at >= patience:
            break
    state.unpersist()
    if validation:
        model.rounds = model.rounds[:max(stop_at, 1)]
    return model


def _gradients(n_classes: int):
    @F.pandas_udf("array<double>")
    def run(margins: pd.Series, y: pd.Series) -> pd.Series:
        p = softmax(matrix(margins, n_classes))
        g = -p
        g[np.arange(len(y)), y.to_numpy()] += 1
        return pd.Series(list(g))
    return run


def _moved(trees: list[dict]):
    @F.pandas_udf("array<double>")
    def run(margins: pd.Series, x: pd.Series) -> pd.Series:
        out, m = matrix(margins, len(trees)).copy(), matrix(x, 1)
        for k, t in enumerate(trees):
            out[:, k] += np.asarray(t["value"])[leaves(t, m)]
        return pd.Series(list(out))
    return lambda margins, x: run(F.col(margins), vector_to_array(F.col(x)))


def _loss(margins: str, y: str) -> Column:
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.log(total) + top - F.get(F.col(margins), F.col(y))


def _newton_values(rows: DataFrame, trees: list[dict], rate: float) -> None:
    """Adds ``value``, each leaf's step, to the trees: sums a leaf from each
    batch, added up by Spark."""
    n = len(trees)

    def run(batches):
        for b in batches:
            x = np.stack(b["x"].to_pylist()) if b.num_rows else np.zeros((0, 1))
            out = []
            for k, t in enumerate(trees):
                g = b[f"g{k}"].to_numpy(zero_copy_only=False)
                at = leaves(t, x)
                size = len(t["feature"])
                up, down = np.bincount(at, g, size), np.bincount(at, np.abs(g) * (1 - np.abs(g)), size)
                out += [(k, i, up[i], down[i]) for i in np.nonzero(np.bincount(at, minlength=size))[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                                             names=["k", "leaf", "up", "down"])

    sums = (rows.withColumn("x", vector_to_array("x")).mapInArrow(run, "k long, leaf long, up double, down double")
            .groupBy("k", "leaf").agg(F.sum("up").alias("up"), F.sum("down").alias("down")))
    for t in trees:
        t["value"] = [0.0] * len(t["feature"])
    for r in sums.collect():  # at most classes x leaves
        trees[r["k"]]["value"][r["leaf"]] = rate * (n - 1) / n * r["up"] / max(r["down"], 1e-9) if n > 1 else 0.0
