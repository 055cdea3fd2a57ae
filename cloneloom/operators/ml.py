"""Evaluation of predictions, folds, permutations, selection, projections and models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.operators.blocks import MOST_SAMPLES, permutations
from cloneloom.operators.cohort import written
from cloneloom.operators.relational import corr, places, running
from cloneloom.products import n_parts, packed

#: Permutations of a first look and of a full test.
SCREEN, FULL = 100, 1000


def evaluate_binary(df: DataFrame, by: Sequence[str], y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """n, prevalence, ROC AUC (ties half), PR AUC (trapezoid), kappa and F1 at a threshold (ML5)."""
    counts = df.groupBy(*by, score).agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    sizes = counts.groupBy(*by).agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    rows = running(counts, by, score, {"_tp": "_p", "_all": "_n"}, descending=True)
    rows = rows.join(sizes, list(by)) if by else rows.crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("_prec", F.col("_tp") / F.col("_all")).withColumn("_rec", F.try_divide("_tp", "_all_p"))
    # The step before: what lies above this score.
    above_p, above = F.col("_tp") - F.col("_p"), F.col("_all") - F.col("_n")
    rows = rows.withColumn("_prec0", F.coalesce(F.try_divide(above_p, above), F.lit(1.0))).withColumn("_rec0", F.try_divide(above_p, F.col("_all_p")))
    over = F.col(score) >= threshold
    negatives = F.col("_n") - F.col("_p")
    out = rows.groupBy(*by).agg(
        F.first("_all_n").alias("n"), F.first("_all_p").alias("n_pos"),
        F.sum(negatives * (F.col("_tp") - F.col("_p") + F.col("_p") / 2.0)).alias("_auc"),
        F.sum((F.col("_rec") - F.col("_rec0")) * (F.col("_prec") + F.col("_prec0")) / 2).alias("pr_auc"),
        F.sum(F.when(over, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(over, negatives).otherwise(0)).alias("fp"),
    )
    n, p, tp, fp = (F.col(c).cast("double") for c in ("n", "n_pos", "tp", "fp"))
    fn, tn = p - tp, n - p - fp
    chance = ((tp + fp) * p + (fn + tn) * (n - p)) / (n * n)
    return out.select(
        *by, "n", (p / n).alias("prevalence"), F.try_divide(F.col("_auc"), p * (n - p)).alias("roc_auc"), "pr_auc",
        F.try_divide((tp + tn) / n - chance, 1 - chance).alias("kappa"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def macro_f1(df: DataFrame, by: Sequence[str], y: str, predicted: str) -> DataFrame:
    """n, accuracy and the mean over classes of F1 (ML5); a class is counted where it is in the truth or in a prediction."""
    counts = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(y).alias("_y"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    each = F.inline(F.array(F.struct(F.col("_y").alias("class"), F.lit(1).alias("_t"), (F.col("_y") == F.col("_p")).cast("int").alias("_hit")), F.struct(F.col("_p").alias("class"), F.lit(0).alias("_t"), F.lit(0).alias("_hit"))))
    per = counts.select(*by, "_n", each).groupBy(*by, "class").agg(F.sum(F.col("_n") * F.col("_hit")).alias("_tp"), F.sum("_n").alias("_both"), F.sum(F.col("_n") * F.col("_t")).alias("_true"))
    return per.groupBy(*by).agg(F.sum("_true").alias("n"), (F.sum("_tp") / F.sum("_true")).alias("accuracy"), F.avg(2 * F.col("_tp") / F.col("_both")).alias("macro_f1"))


def observed_p(scores: DataFrame, keys: Sequence[str], stat: str, shuffle: str) -> DataFrame:
    """(keys, stat, p, n_shuffles): (1 + shuffles at least as large) / (1 + shuffles), rows with a null shuffle being the real ones."""
    real, null = scores.where(F.col(shuffle).isNull()).drop(shuffle), scores.where(F.col(shuffle).isNotNull()).select(*keys, stat)
    return permutation_p(real, null, keys, stat).withColumnRenamed("n_perms", "n_shuffles")


def averaged_models(train: DataFrame, apply_to: DataFrame, key: str, y: str, features: Sequence[str], k: int = 3, seed: int = 1) -> DataFrame:
    """(key, score): rows scored by the k models that each left one fold of the training rows out, on average (ML6)."""
    from functools import reduce

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows, other = train.select(key, y, *features).na.drop().withColumn("fold", fold_of(key, k, seed)), apply_to.select(key, *features).na.drop()
    steps = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z"), LogisticRegression(featuresCol="_z", labelCol=y, regParam=0.01)]
    scored = [Pipeline(stages=steps).fit(rows.where(F.col("fold") != i)).transform(other).select(key, vector_to_array("probability")[1].alias("score")) for i in range(k)]
    return reduce(DataFrame.unionByName, scored).groupBy(key).agg(F.avg("score").alias("score"))


def evaluate_regression(df: DataFrame, by: Sequence[str], y: str, predicted: str, ranks: bool = False) -> DataFrame:
    """n, R2, Pearson r and explained variance (ML5), with ranks also Spearman's r."""
    if ranks:
        from cloneloom.operators.stats import correlations

        plain, spearman = evaluate_regression(df, by, y, predicted), correlations(df, by, y, predicted, "spearman").select(*by, F.col("r").alias("spearman"))
        return plain.join(spearman, list(by), "left") if by else plain.crossJoin(F.broadcast(spearman))  # one row
    error = F.col(y) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum(error**2), F.var_pop(y) * F.count("*"))).alias("r2"), corr(y, predicted).alias("pearson"), (1 - F.try_divide(F.var_pop(error), F.var_pop(y))).alias("explained_variance")
    )


def decile_rates(df: DataFrame, y: str, score: str, q: int = 10) -> DataFrame:
    """Positive rate per quantile bin of the score."""
    from cloneloom.operators.relational import qcut

    return qcut(df, score, q).groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("rate"))


def verdict(before: Column, after: Column, truth: Column, margin: float = 0.05) -> Column:
    """'no change' inside the margin, else whether the score moved towards the truth."""
    delta = after - before
    return F.when(F.abs(delta) < margin, "no change").when((delta > margin) & (truth == 1) | (delta < -margin) & (truth == 0), "correct").otherwise("in correct")


def fold_of(key: str, k: int, seed: int) -> Column:
    """Fold 0..k-1 of a key, the same in every run."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def permuted_labels(df: DataFrame, key: str, label: str, n_perms: int, seed: int) -> DataFrame:
    """(perm, key, label) with labels dealt anew in each permutation (R5): two orders of the same rows, joined by place."""
    ordered = written(places(df.select(key, label), key, "_a"), "order")  # one order for all permutations
    every = F.explode(F.sequence(F.lit(1), F.lit(n_perms))).alias("perm")
    dealt = F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col(key).cast("string")).cast("binary")))
    # The first byte of the hash makes ranges of about equal size.
    rows = ordered.select(key, label, every).withColumn("_h", dealt).withColumn("_range", F.substring("_h", 1, 1))
    before = Window.partitionBy("perm").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("perm", "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("perm", "_range").orderBy("_h", key))
    other = rows.withColumn("_own", own).join(starts, ["perm", "_range"]).select("perm", (F.col("_own") + F.col("_start")).alias("_a"), F.col(label).alias("permuted"))
    # A place is one row, whatever the permutation, so the rows alone are joined by place.
    return other.join(ordered.select("_a", key), "_a").select("perm", key, F.col("permuted").alias(label))


def permutation_p(real: DataFrame, shuffled: DataFrame, keys: Sequence[str], stat: str) -> DataFrame:
    """(1 + shuffles at least as large) / (1 + shuffles) per key (R6, R8); shuffles without a statistic count as none."""
    on = list(keys)
    a = real.withColumnRenamed(stat, "_real")
    joined = a.join(shuffled, on) if on else a.crossJoin(shuffled)
    return joined.groupBy(*on, "_real").agg(((1 + F.coalesce(F.sum((F.col(stat) >= F.col("_real")).cast("int")), F.lit(0))) / (1 + F.count(stat))).alias("p"), F.count(stat).alias("n_perms")).withColumnRenamed("_real", stat)


def permuted_auc(df: DataFrame, key: str, y: str, score: str, n_perms: int, seed: int) -> DataFrame:
    """(perm, away): |AUC - 0.5| of labels dealt anew as by permuted_labels, a row a permutation.

    Scores are ranked and rows placed once.  A task reads them in chunks, in the order of their places, and makes its permutations from hashes of
    the keys, so no row is shuffled for a permutation.  Tables of more than MOST_SAMPLES rows deal labels with permuted_labels and join.
    """
    rows = written(df.select(key, F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("y"), F.col(score).alias("score")).where(F.col(key).isNotNull()), "scored")
    n = rows.count()
    if n > MOST_SAMPLES:
        labels = permuted_labels(df.select(key, y), key, y, n_perms, seed)
        return evaluate_binary(labels.join(df.select(key, score), key), ["perm"], y, score).select("perm", F.abs(F.col("roc_auc") - 0.5).alias("away"))
    counts = rows.groupBy("score").agg(F.count("*").alias("_n"))
    ranks = running(counts, [], "score", {"_upto": "_n"}).select(F.col("score").alias("_s"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_rank"))
    ranked = written(rows.join(ranks, F.col("score").eqNullSafe(F.col("_s"))).select(key, "y", "_rank"), "ranked")
    placed = places(ranked, key, "_place").select("_place", F.col(key).cast("string").alias("name"), "y", "_rank")
    chunks = packed(placed, n_parts(n, 1 << 16), 1 << 16, order=("_place",))
    tasks = min(n_perms, 2 * df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.sparkSession.range(0, tasks, 1, tasks).withColumnRenamed("id", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                task = batch.column("task")[i].as_py()
                pieces.append(pa.ipc.open_stream(batch.column("data")[i].as_buffer()).read_all())
        if task is None:
            return
        table = pa.concat_tables(pieces).sort_by("_place")
        names, labels, rank = table.column("name").to_pylist(), table.column("y").to_numpy(), table.column("_rank").to_numpy()
        positive = labels.sum()
        pairs = positive * (len(labels) - positive)
        own = range(1 + task, n_perms + 1, tasks)
        away = [abs((rank @ labels[permutations(names, 1, seed, k)[0]] - positive * (positive + 1) / 2) / pairs - 0.5) if pairs else None for k in own]
        yield pa.RecordBatch.from_pydict({"perm": pa.array(own, pa.int32()), "away": pa.array(away, pa.float64())})

    met = chunks.select("data").coalesce(1).hint("shuffle_replicate_nl").join(dealt)
    return met.mapInArrow(run, "perm int, away double")


def adaptive_auc_p(df: DataFrame, key: str, y: str, score: str, seed: int, screen: int = SCREEN, full: int = FULL, below: float = 0.02) -> DataFrame:
    """Permutation p of |AUC - 0.5|: ``screen`` permutations, and ``full`` where the first p is under ``below``."""
    real = evaluate_binary(df, [], y, score).select(F.abs(F.col("roc_auc") - 0.5).alias("away"))

    def run(n):
        return written(permutation_p(real, permuted_auc(df, key, y, score, n, seed).select("away"), [], "away"), "auc")

    first = run(screen)
    return run(full) if first.first()["p"] < below else first


def select_k_best(long: DataFrame, feature: str, value: str, y: str, k: int) -> DataFrame:
    """The k features of greatest |r| with y (ML1)."""
    return long.groupBy(feature).agg(corr(value, y).alias("r")).orderBy(F.desc_nulls_last(F.abs("r")), feature).limit(k)


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with k principal-component scores (CL12): covariance by Spark, its eigenvectors on the driver (d x d)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    return model.transform(rows).withColumn("components", vector_to_array("_pc")).drop("_v", "_pc")


def logistic_p_values(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """Coefficients, errors and p-values of a binomial regression (ST26)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.select(y, *features).na.drop())
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=y, maxIter=50).fit(rows)
    s = model.summary
    values = zip([*features, "intercept"], [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.pValues)
    return df.sparkSession.createDataFrame([(n, float(c), float(e), float(p)) for n, c, e, p in values], "feature string, coefficient double, error double, p double")


def linear_p_values(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """Coefficients, errors and p-values of ordinary least squares, with r2 and adjusted r2 (ST26)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.select(F.col(y).cast("double").alias(y), *features).na.drop())
    s = (model := LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(rows)).summary
    values = zip([*features, "intercept"], [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.pValues)
    return df.sparkSession.createDataFrame([(n, float(c), float(e), float(p), float(s.r2), float(s.r2adj)) for n, c, e, p in values], "feature string, coefficient double, error double, p double, r2 double, r2_adjusted double")


def nested_logistic(df: DataFrame, y: str, steps: Sequence[str]) -> DataFrame:
    """(step, feature, deviance, pseudo_r2, pseudo_r2_adjusted, gain, p) of logistic models that take in one feature more at each step (ST27).

    pseudo_r2 is McFadden's, adjusted by the number of features; p is the likelihood-ratio test of the step.
    """
    import math

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from cloneloom.functions.special import chi2_upper

    rows = df.select(y, *steps).na.drop().cache()
    n, positive = rows.agg(F.count("*"), F.sum(y)).first()
    rate = positive / n
    null = -2 * (positive * math.log(rate) + (n - positive) * math.log(1 - rate))
    out, before, adjusted_before = [], null, 0.0
    for i in range(1, len(steps) + 1):
        x = VectorAssembler(inputCols=list(steps[:i]), outputCol="_x").transform(rows)
        deviance = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol=y, maxIter=50).fit(x).summary.deviance
        adjusted = 1 - (deviance / 2 + i) / (null / 2)
        out.append((i, steps[i - 1], float(deviance), 1 - deviance / null, adjusted, adjusted - adjusted_before, float(chi2_upper([max(before - deviance, 0.0)], [1])[0])))
        before, adjusted_before = deviance, adjusted
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "step int, feature string, deviance double, pseudo_r2 double, pseudo_r2_adjusted double, gain double, p double")


def out_of_fold(df: DataFrame, key: str, y: str, features: Sequence[str], k: int = 3, seed: int = 1) -> DataFrame:
    """(key, y, fold, score): each row scored by a model that was fitted without its fold (ML1)."""
    from functools import reduce

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(key, y, *features).na.drop().withColumn("fold", fold_of(key, k, seed))
    steps = [VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z"), LogisticRegression(featuresCol="_z", labelCol=y, regParam=0.01)]
    parts = []
    for i in range(k):
        model = Pipeline(stages=steps).fit(rows.where(F.col("fold") != i))
        parts.append(model.transform(rows.where(F.col("fold") == i)).select(key, y, "fold", vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, parts)


def task_type(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """binary, multiclass or regression by the number of different values (ML4)."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "target", "n_values")
    return long.withColumn("task", F.when(F.col("n_values") == 2, "binary").when(F.col("n_values") < 7, "multiclass").otherwise("regression"))
