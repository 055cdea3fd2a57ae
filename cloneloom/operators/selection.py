"""Choice of models: folds, parameter search inside folds, predictions outside them.

Folds are columns of the table, so every fit is a filter on one written feature table.  A search fits its candidates side
by side from a few driver threads; each fit is a distributed job, and what comes back to the driver are scores.
"""

from __future__ import annotations

import itertools
import json
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneloom.operators.cohort import shared_dir, written
from cloneloom.operators.ml import evaluate_binary, evaluate_regression
from cloneloom.operators.relational import places

#: How many folds of the outer and the inner split, candidates of a search, and fits at a time.
OUTER, INNER, CANDIDATES, AT_A_TIME = 3, 3, 6, 4


# Folds


def _hashed(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def stratified_folds(df: DataFrame, key: str, y: str, k: int, seed: int = 1, out: str = "fold") -> DataFrame:
    """df with a fold 0..k-1 in which every class has its share: within a class the folds' sizes differ by at most 1 (R9, ML1).

    Rows of a class are placed in the order of a hash, in ranges; folds are places modulo k.  A null class is one more class.
    """
    order = F.struct(_hashed(key, seed).alias("h"), F.col(key).alias("k"))
    rows = df.withColumn("_class", F.coalesce(F.col(y).cast("string"), F.lit(""))).withColumn("_isnull", F.col(y).isNull()).withColumn("_order", order)
    return places(rows, "_order", "_place", ["_class", "_isnull"]).withColumn(out, ((F.col("_place") - 1) % k).cast("int")).select(*df.columns, out)


def group_folds(df: DataFrame, group: str, k: int, seed: int = 1, out: str = "fold") -> DataFrame:
    """df with a fold 0..k-1 that keeps every group together (R9, ML1): groups are dealt by size, largest first, to and fro over the folds.

    Rows without a group form one.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    order = F.struct((-F.col("_n")).alias("n"), _hashed(group, seed).alias("h"), F.col(group).alias("g"))
    turn = (F.col("_place") - 1) % (2 * k)
    dealt = places(sizes.withColumn("_order", order), "_order", "_place").select(F.col(group).alias("_group"), F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias(out))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, out)


def leave_one_group_out(df: DataFrame, group: str, out: str = "fold") -> DataFrame:
    """df with a fold for each group, numbered in the order of the groups, a null one first."""
    order = F.struct(F.col(group).alias("g"))
    numbered = places(df.select(group).distinct().withColumn("_order", order), "_order", "_place").select(F.col(group).alias("_group"), (F.col("_place") - 1).cast("int").alias(out))
    return df.join(numbered, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, out)


# Candidates


@dataclass(frozen=True)
class Candidate:
    """A learner and its parameters; ``k_best`` (if any) features are chosen on the training rows."""

    learner: str
    params: tuple[tuple[str, object], ...]

    @property
    def text(self) -> str:
        return json.dumps(dict(self.params), sort_keys=True)


#: Parameter spaces of the learners, by task.
SPACES = {
    "logistic": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "linear": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "forest": {"numTrees": [20, 50], "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5]},
    "boosted": {"maxIter": [10, 20], "maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3]},
}
TASKS = {"binary": ("logistic", "forest", "boosted"), "regression": ("linear", "forest", "boosted")}


def candidates(spaces: dict[str, dict[str, Sequence]], n: int | None = None, seed: int = 1) -> list[Candidate]:
    """Every combination of each space, or n of them drawn with a seed, the learners in turn (a random search)."""
    every = {name: [Candidate(name, tuple(zip(space, values))) for values in itertools.product(*space.values())] for name, space in spaces.items()}
    if n is None:
        return [c for own in every.values() for c in own]
    draw = random.Random(seed)
    for own in every.values():
        draw.shuffle(own)
    turns = itertools.zip_longest(*every.values())
    return [c for turn in turns for c in turn if c is not None][:n]


def _pipeline(task: str, candidate: Candidate, y: str, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector

    params, stages, features = dict(candidate.params), [], "features"
    if k_best := params.pop("k_best", None):
        kind = "categorical" if task == "binary" else "continuous"
        stages.append(UnivariateFeatureSelector(featuresCol=features, labelCol=y, outputCol="_best", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(k_best))
        features = "_best"
    if candidate.learner in ("logistic", "linear"):
        stages.append(StandardScaler(inputCol=features, outputCol="_scaled"))
        features = "_scaled"
    made = {
        ("binary", "logistic"): C.LogisticRegression, ("binary", "forest"): C.RandomForestClassifier, ("binary", "boosted"): C.GBTClassifier,
        ("regression", "linear"): R.LinearRegression, ("regression", "forest"): R.RandomForestRegressor, ("regression", "boosted"): R.GBTRegressor,
    }[task, candidate.learner](featuresCol=features, labelCol=y)
    if made.hasParam("seed"):
        params["seed"] = seed
    return Pipeline(stages=[*stages, made.copy({made.getParam(k): v for k, v in params.items()})])


def fitted(task: str, candidate: Candidate, y: str, train: DataFrame, seed: int):
    """The pipeline of a candidate fitted on training rows; its last stage is the learner's model."""
    return _pipeline(task, candidate, y, seed).fit(train)


def fitted_scores(task: str, candidate: Candidate, y: str, train: DataFrame, test: DataFrame, seed: int) -> DataFrame:
    """test with score: the probability of class 1, or the predicted value, by a model of the training rows."""
    from pyspark.ml.functions import vector_to_array

    rows = fitted(task, candidate, y, train, seed).transform(test)
    score = vector_to_array("probability")[1] if task == "binary" else F.col("prediction")
    return rows.select(*test.columns, score.alias("score"))


def measured(task: str, rows: DataFrame, y: str) -> float | None:
    """The figure that a search maximises: ROC AUC, or R2."""
    return evaluate_binary(rows, [], y, "score").first()["roc_auc"] if task == "binary" else evaluate_regression(rows, [], y, "score").first()["r2"]


def feature_table(df: DataFrame, key: str, y: str, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(key, y, extra, features): rows without nulls, the features as one vector, written to the shared folder and read from there."""
    from pyspark.ml.feature import VectorAssembler

    shared_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/features-{uuid.uuid4().hex}"
    rows = df.select(key, F.col(y).cast("double").alias(y), *extra, *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=[y, *features])
    VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).drop(*[f for f in features if f not in (key, y, *extra)]).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def search(task: str, rows: DataFrame, y: str, fold: str, tried: Sequence[Candidate], seed: int = 1, at_a_time: int = AT_A_TIME) -> list[tuple[Candidate, float]]:
    """Each candidate with its mean figure over the folds of a column, best first; ties go by learner and parameters."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a few

    def figure(job: tuple[Candidate, int]) -> float | None:
        candidate, i = job
        return measured(task, fitted_scores(task, candidate, y, rows.where(F.col(fold) != i), rows.where(F.col(fold) == i), seed), y)

    jobs = list(itertools.product(tried, folds))
    with ThreadPoolExecutor(at_a_time) as pool:
        figures = dict(zip(jobs, pool.map(figure, jobs)))
    means = []
    for c in tried:
        known = [figures[c, i] for i in folds if figures[c, i] is not None]
        means.append((c, sum(known) / len(known) if known else float("-inf")))
    return sorted(means, key=lambda x: (-x[1], x[0].learner, x[0].text))


@dataclass
class Selected:
    """chosen: (fold, learner, params, inner_score, score, n), a row per outer fold; tried: (fold, learner, params, inner_score); predictions: (key, y, fold, score), a row per row of the table."""

    chosen: DataFrame
    tried: DataFrame
    predictions: DataFrame


def nested_selection(
    df: DataFrame, key: str, y: str, features: Sequence[str], task: str = "binary", group: str | None = None, spaces: dict | None = None,
    outer: int = OUTER, inner: int = INNER, n_candidates: int | None = CANDIDATES, seed: int = 1, at_a_time: int = AT_A_TIME,
) -> Selected:
    """Choice of learner and parameters inside each outer fold, scored on the rows outside (ML1, ML2).

    Outer and inner folds keep class shares, or whole groups together if a group column is given.  In each outer fold
    the candidates are searched over inner folds of its training rows only, the best one is fitted on all of these and
    scores the fold's own rows; so no row has a part in the choice of the model that scores it.
    """
    spark: SparkSession = df.sparkSession
    spaces = spaces or {name: SPACES[name] for name in TASKS[task]}
    tried = candidates(spaces, n_candidates, seed)
    columns = [key, y, *([group] if group else []), *features]
    rows = df.select(*dict.fromkeys(columns)).na.drop(subset=[y, *features])

    def split(part: DataFrame, k: int, salt: int, out: str) -> DataFrame:
        if group:
            return group_folds(part, group, k, salt, out)
        return stratified_folds(part, key, y if task == "binary" else "_one", k, salt, out)

    rows = written(rows.withColumn("_one", F.lit(1)), "rows")  # made once: each split counts and places its rows in passes of its own
    for out, k, salt in (("fold", outer, seed), *((f"_inner{i}", inner, seed + 1 + i) for i in range(outer))):
        if out == "fold":
            rows = split(rows, k, salt, out)
        else:  # inner folds of the rows outside an outer fold
            i = int(out.removeprefix("_inner"))
            part = split(rows.where(F.col("fold") != i), k, salt, out)
            rows = part.unionByName(rows.where(F.col("fold") == i).withColumn(out, F.lit(None).cast("int")))
        rows = written(rows, "rows")  # the next split starts from these folds
    table = feature_table(rows, key, y, features, ["fold", *(f"_inner{i}" for i in range(outer))])
    chosen, figures, scored = [], [], []
    for i in range(outer):
        train, test = table.where(F.col("fold") != i), table.where(F.col("fold") == i)
        found = search(task, train, y, f"_inner{i}", tried, seed, at_a_time)
        best, inner_score = found[0]
        part = fitted_scores(task, best, y, train, test, seed).select(key, y, "fold", "score")
        scored.append(part)
        figures += [(i, c.learner, c.text, float(s)) for c, s in found]
        chosen.append((i, best.learner, best.text, float(inner_score), measured(task, part, y), part.count()))
    return Selected(
        spark.createDataFrame(chosen, "fold int, learner string, params string, inner_score double, score double, n long"),
        spark.createDataFrame(figures, "fold int, learner string, params string, inner_score double"),
        reduce(DataFrame.unionByName, scored),
    )

