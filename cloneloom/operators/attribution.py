"""Shapley values: how much each feature of a row moves a model's score from its mean (ML7).

Linear models have theirs in closed form, as expressions.  Of trees the path-dependent values are computed exactly from the
model's own node table: a feature that is not known goes both ways, in the shares of the training rows.  A leaf's part in
the score is a product over the features of its path, so what each of them adds depends only on which of their conditions
a row meets; that is a small table for each leaf, looked up for a batch of rows at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.operators.cohort import shared_dir

#: Features of a path up to which all patterns of met conditions are tabled; nodes of a model at most.
TABLED, MOST_NODES = 10, 1 << 20


def linear_shapley(df: DataFrame, key: str, coefficients: dict[str, float], means: dict[str, float] | None = None) -> DataFrame:
    """(key, feature, value, shap) of a linear score: coefficient x (value - mean); means default to those of df.

    A null value adds nothing.  On the scale of the linear score: for logistic models, of the log odds.
    """
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in coefficients])
    if means is None:
        means = rows.agg(*[F.avg(c).alias(c) for c in coefficients]).first().asDict()
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.coalesce(F.lit(coefficients[c]) * (F.col(c) - F.lit(means[c] or 0.0)), F.lit(0.0)).alias("shap"))
    return rows.select(key, F.inline(F.array(*map(entry, coefficients))))


@dataclass
class Leaf:
    """A leaf's part of the score: for each feature of its path the values that lead there, and the share of training rows that they had."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(model) -> DataFrame:
    """(tree, weight, id, value, cover, left, right, feature, threshold) of a fitted tree model, a row per node.

    value is what a leaf adds to the score: the probability of class 1 (forests and trees of classes), or the prediction;
    weight is the tree's.  The scores of boosted classes are half log odds.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/model-{uuid.uuid4().hex}"
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    kind = type(model).__name__
    if "treeID" in rows.columns:
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = rows.select(F.lit(0).alias("tree"), "*")
    classes = kind in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")
    stats = F.col("impurityStats")
    value = F.try_divide(stats[1], F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)) if classes else F.col("prediction")
    weights = [float(w) for w in model.treeWeights] if hasattr(model, "treeWeights") else [1.0]
    total = sum(weights) if kind.startswith("RandomForest") else 1.0
    weight = F.element_at(F.array(*[F.lit(w / total) for w in weights]), F.col("tree") + 1)
    return rows.select(
        "tree", weight.alias("weight"), "id", value.alias("value"), F.col("rawCount").cast("double").alias("cover"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.when(F.col("split.numCategories") > 0, F.raise_error(F.lit("categorical splits have no threshold")).cast("double")).otherwise(F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
    )


def leaves(nodes: Sequence) -> list[Leaf]:
    """The leaves of all trees of a node table."""
    by = {(r["tree"], r["id"]): r for r in nodes}
    out = []
    for tree in sorted({t for t, _ in by}):
        open_ = [(by[tree, 0], {})]
        while open_:
            node, path = open_.pop()
            if node["left"] < 0:
                if path or node["value"]:
                    order = sorted(path)
                    out.append(Leaf(node["weight"] * node["value"], np.array(order, np.int64), *(np.array([path[f][k] for f in order], float) for k in range(3))))
                continue
            low, high, share = path.get(node["feature"], (-math.inf, math.inf, 1.0))
            left, right = by[tree, node["left"]], by[tree, node["right"]]
            open_.append((left, path | {node["feature"]: (low, min(high, node["threshold"]), share * left["cover"] / node["cover"])}))
            open_.append((right, path | {node["feature"]: (max(low, node["threshold"]), high, share * right["cover"] / node["cover"])}))
    return out


def contributions(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What each feature adds to a product game of 1 if a condition is met, its share if it is not known; a row for each row of met.

    Coefficients of the product over the other features, by how many of them are known, weighted as Shapley's are.
    """
    n, d = met.shape
    weights = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.empty((n, d))
    for j in range(d):
        poly = np.zeros((n, d))
        poly[:, 0] = 1.0
        for i in range(d):
            if i != j:
                poly[:, 1:] = poly[:, 1:] * share[i] + poly[:, :-1] * met[:, i, None]
                poly[:, 0] *= share[i]
        out[:, j] = (met[:, j] - share[j]) * (poly @ weights)
    return out


class Explainer:
    """The Shapley values of batches of rows under a list of leaves."""

    def __init__(self, found: list[Leaf], width: int):
        self.leaves, self.width, self.tables = found, width, []
        self.base = sum(leaf.value * float(np.prod(leaf.share)) for leaf in found)
        for leaf in found:
            d = len(leaf.features)
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float) if 0 < d <= TABLED else None
            self.tables.append(None if patterns is None else leaf.value * contributions(patterns, leaf.share))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, values) of rows of features."""
        score, out = np.zeros(len(x)), np.zeros((len(x), self.width))
        for leaf, table in zip(self.leaves, self.tables):
            if not len(leaf.features):
                score += leaf.value
                continue
            part = x[:, leaf.features]
            met = ~(part <= leaf.low) & ((part <= leaf.high) | np.isinf(leaf.high))  # what is not a number goes right
            score += leaf.value * met.all(axis=1)
            if table is None:
                values = leaf.value * contributions(met.astype(float), leaf.share)
            else:
                values = table[met @ (1 << np.arange(len(leaf.features)))]
            out[:, leaf.features] += values
        return score, out


def tree_shapley(df: DataFrame, key: str, model, features: Sequence[str]) -> DataFrame:
    """(key, base, score, shap): shap is an array in the order of features, base the mean score; base + sum(shap) = score.

    features: the columns that were assembled for the model.  Scores are those of node_table.  Nulls count as not a number.
    """
    nodes = node_table(model).limit(MOST_NODES + 1).collect()
    if len(nodes) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    sent = df.sparkSession.sparkContext.broadcast(leaves(nodes))  # MOST_NODES at most
    kind = dict(df.dtypes)[key]
    rows = df.select(key, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])

    def run(batches):
        explain = Explainer(sent.value, len(features))
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1) if batch.num_rows else np.zeros((0, len(features)))
            score, values = explain(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), explain.base)), pa.array(score), lists], names=[key, "base", "score", "shap"])

    return rows.mapInArrow(run, f"{key} {kind}, base double, score double, shap array<double>")


def long_values(shap: DataFrame, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, feature, value, shap) of tree_shapley's rows, with the features' own values."""
    values = F.array(*[F.col(c).cast("double") for c in features])
    pairs = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), values.alias("value"), F.col("shap"))
    return shap.select(key, "shap").join(df.select(key, *features), key).select(key, F.inline(pairs)).toDF(key, "feature", "value", "shap")


def ranked_features(values: DataFrame, n: int | None = None) -> DataFrame:
    """(feature, total, mean, direction, place) by the sum of absolute values, the n largest if given (ML7).

    direction is the sign of the correlation of value and shap: whether larger values raise the score.
    """
    from cloneloom.operators.relational import corr

    sums = values.groupBy("feature").agg(F.sum(F.abs("shap")).alias("total"), F.avg(F.abs("shap")).alias("mean"), F.sign(corr("value", "shap")).alias("direction"))
    order = sums.orderBy(F.desc("total"), "feature")
    top = order if n is None else order.limit(n)  # features, not rows
    above = F.size(F.filter(F.col("all"), lambda x: (x["t"] > F.col("total")) | (x["t"] == F.col("total")) & (x["f"] < F.col("feature"))))
    every = sums.agg(F.collect_list(F.struct(F.col("total").alias("t"), F.col("feature").alias("f"))).alias("all"))
    return top.crossJoin(F.broadcast(every)).select("feature", "total", "mean", "direction", (above + 1).alias("place"))  # one row, the features
