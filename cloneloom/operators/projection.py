"""Principal components of sparse samples x features and principal coordinates of pair tables, by block power iteration.

A block of b columns is kept as a table (id, v0 ... ), orthonormal.  A round applies the operator by joins and aggregates,
with centring done by arithmetic on sums, so nothing is made dense; the driver sees b x b products only.  Rayleigh-Ritz on
the block gives values and directions, whose residuals say when to stop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.operators.cohort import shared_dir, written
from cloneloom.operators.relational import places
from cloneloom.operators.stats import anova, ks_two_sample, mann_whitney, t_test

#: Columns of a block beyond those asked for, rounds at most, and the residual (over the largest value) to stop at; it can be told to about 1e-7.
EXTRA, ROUNDS, TOLERANCE = 8, 60, 3e-7


@dataclass
class Projection:
    """scores: (sample, pc1 ... ); values: eigenvalues of the axes; shares: their part of the whole variance; rounds: rounds it took."""

    scores: DataFrame
    values: list[float]
    shares: list[float]
    rounds: int
    loadings: DataFrame | None = None


def _names(b: int, letter: str = "v") -> list[str]:
    return [f"{letter}{i}" for i in range(b)]


def _block(batch: pa.RecordBatch, letter: str, n: int) -> np.ndarray:
    return np.stack([batch.column(f"{letter}{i}").to_numpy() for i in range(n)], axis=1)


def _turned(df: DataFrame, *parts: tuple[str, np.ndarray]) -> DataFrame:
    """(id, v0 ...): the sum of blocks (by the letter of their columns) times small matrices."""
    out = parts[0][1].shape[1]
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = sum(_block(batch, letter, len(matrix)) @ matrix for letter, matrix in parts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(rows[:, i]) for i in range(out)]], names=["id", *_names(out)])

    return df.mapInArrow(run, ", ".join([f"id {kind}", *[f"v{i} double" for i in range(out)]]))


def _products(df: DataFrame, a: str, b: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of block columns a x b and b x b: a small matrix from each task, added up."""

    def run(batches):
        total = np.zeros((2 * n, n))
        for batch in batches:
            x, y = _block(batch, a, n), _block(batch, b, n)
            total += np.concatenate([x, y], axis=1).T @ y
        yield pa.RecordBatch.from_pydict({"cell": np.arange(2 * n * n), "value": total.ravel()})

    rows = df.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect()  # 2 n x n cells
    out = np.zeros(2 * n * n)
    for cell, value in rows:
        out[cell] = value
    return out[: n * n].reshape(n, n), out[n * n :].reshape(n, n)


def _start(ids: DataFrame, b: int, seed: int) -> DataFrame:
    """(id, v0 ...): numbers in -1..1 drawn by a hash of the id."""
    return ids.select("id", *[(F.xxhash64(F.lit(seed), F.lit(i), "id") / F.lit(2.0**63)).alias(f"v{i}") for i in range(b)])


def top_eigenvectors(
    ids: DataFrame, apply: Callable[[DataFrame, int], DataFrame], k: int, n: int, positive: bool = False, extra: int = EXTRA, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 1
) -> tuple[DataFrame, np.ndarray, int]:
    """(id, v0 ... v(k-1)) orthonormal, their eigenvalues, and the rounds taken, of a symmetric operator on n ids.

    apply(block, b) gives the operator times the block (id, w0 ...).  The k eigenvalues of largest size are found, or the k
    largest positive ones; ids of one column are enough to tell axes apart where fewer exist.
    """
    shared_dir(ids.sparkSession)
    b = min(n, k + extra)
    block = _start(ids, b, seed).checkpoint(eager=True)
    _, gram = _products(block, "v", "v", b)
    block = _turned(block, ("v", np.linalg.inv(np.linalg.cholesky(gram + np.eye(b) * 1e-13 * np.trace(gram))).T))
    for turn in range(1, rounds + 1):
        both = block.join(apply(block, b), "id").checkpoint(eager=True)
        ritz, gram = _products(both, "v", "w", b)
        values, vectors = np.linalg.eigh((ritz + ritz.T) / 2)
        order = np.argsort(-values if positive else -np.abs(values), kind="stable")
        values, vectors = values[order], vectors[:, order]
        scale = max(np.abs(values).max(), 1e-300)
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", vectors, gram, vectors) - values**2, 0)) / scale
        if residual[:k].max(initial=0) <= tolerance or turn == rounds:
            return _turned(both, ("v", vectors[:, :k])), values[:k], turn
        # Directions over their values are nearly orthonormal already, so their products are well conditioned.
        size = np.where(np.abs(values) > 1e-12 * scale, values, scale)
        near = vectors / size
        gram = near.T @ gram @ near
        root, turned = np.linalg.eigh((gram + gram.T) / 2)
        # A direction that the operator takes to nothing stays as it was.
        lost = root < 1e-10
        matrix = near @ turned / np.sqrt(np.where(lost, 1.0, root))
        block = _turned(both, ("w", np.where(lost[None, :], 0.0, matrix)), ("v", np.where(lost[None, :], vectors @ turned, 0.0)))
    raise AssertionError


def _signed(scores: DataFrame, k: int) -> DataFrame:
    """Axes turned so that their largest score is positive."""
    one = scores.agg(*[F.sign(F.max_by(f"v{i}", F.struct(F.abs(F.round(f"v{i}", 9)), F.col("id").cast("string")))).alias(f"s{i}") for i in range(k)])
    return scores.crossJoin(F.broadcast(one)).select("id", *[(F.col(f"v{i}") * F.coalesce(F.nullif(F.col(f"s{i}"), F.lit(0.0)), F.lit(1.0))).alias(f"v{i}") for i in range(k)])  # one row


def principal_axes(cells: DataFrame, sample: str, feature: str, value: str, k: int = 2, samples: DataFrame | None = None, **how) -> Projection:
    """Principal components of a sparse matrix of (sample, feature, value), a row for each cell that is not zero (CL12).

    Features are centred.  samples adds those that have no cell.  scores are the samples' places on the axes, loadings the
    features' weights, shares the axes' parts of the variance of all features.
    """
    x = cells.where(F.col(value).isNotNull()).select(F.col(sample).alias("s"), F.col(feature).alias("f"), F.col(value).cast("double").alias("x"))
    every = (samples.select(F.col(sample).alias("s")) if samples is not None else x.select("s")).distinct()
    n = every.count()
    means = x.groupBy("f").agg((F.sum("x") / n).alias("m"), F.sum(F.col("x") ** 2).alias("q"))
    whole = means.agg(F.count("*").alias("p"), F.sum(F.col("q") - n * F.col("m") ** 2).alias("t")).first()
    x = x.join(means.select("f", "m"), "f")

    def placed(block: DataFrame, b: int) -> DataFrame:
        """(s, z0 ...): the centred samples times a block over features."""
        off = block.join(means, F.col("id") == F.col("f")).agg(*[F.coalesce(F.sum(F.col("m") * F.col(f"v{i}")), F.lit(0.0)).alias(f"o{i}") for i in range(b)])
        sums = x.join(block.withColumnRenamed("id", "f"), "f").groupBy("s").agg(*[F.sum(F.col("x") * F.col(f"v{i}")).alias(f"z{i}") for i in range(b)])
        return every.join(sums, "s", "left").crossJoin(F.broadcast(off)).select("s", *[(F.coalesce(f"z{i}", F.lit(0.0)) - F.col(f"o{i}")).alias(f"z{i}") for i in range(b)])  # one row

    def apply(block: DataFrame, b: int) -> DataFrame:
        z = placed(block, b).checkpoint(eager=True)
        total = z.agg(*[F.sum(f"z{i}").alias(f"t{i}") for i in range(b)])
        sums = x.join(z, "s").groupBy("f", "m").agg(*[F.sum(F.col("x") * F.col(f"z{i}")).alias(f"w{i}") for i in range(b)])
        return sums.crossJoin(F.broadcast(total)).select(F.col("f").alias("id"), *[(F.col(f"w{i}") - F.col("m") * F.col(f"t{i}")).alias(f"w{i}") for i in range(b)])  # one row

    k = min(k, whole["p"], max(n - 1, 0))
    if not k:
        return Projection(every.withColumnRenamed("s", sample), [], [], 0)
    axes, values, turns = top_eigenvectors(means.select(F.col("f").alias("id")), apply, k, whole["p"], **how)
    scores = _signed(placed(axes, k).select(F.col("s").alias("id"), *[F.col(f"z{i}").alias(f"v{i}") for i in range(k)]), k)
    named = lambda df, c: df.select(F.col("id").alias(c), *[F.col(f"v{i}").alias(f"pc{i + 1}") for i in range(k)])
    values = [max(float(v), 0.0) for v in values]
    return Projection(named(scores, sample), [v / max(n - 1, 1) for v in values], [v / whole["t"] if whole["t"] else 0.0 for v in values], turns, named(axes, feature))


def principal_coordinates(pairs: DataFrame, k: int = 2, **how) -> Projection:
    """Principal coordinates of a table with each pair of samples once (sample1, sample2, dist) (CL13).

    The operator is -1/2 J D2 J with squared distances D2 and centring J; a sample's distance to itself is 0.  Axes are those of
    the largest positive eigenvalues, scores have their square roots as length; shares are parts of the sum of squares.
    """
    pairs = written(pairs.select("sample1", "sample2", "dist"), "coordinates")  # read in each round
    both = pairs.select(F.col("sample1").alias("a"), F.col("sample2").alias("c"), (F.col("dist") ** 2).alias("d2"))
    both = both.unionByName(both.select(F.col("c").alias("a"), F.col("a").alias("c"), "d2"))
    ids = both.select(F.col("a").alias("id")).distinct()
    n = ids.count()
    trace = (pairs.agg(F.sum(F.col("dist") ** 2)).first()[0] or 0.0) / max(n, 1)

    def times(block: DataFrame, b: int) -> DataFrame:
        off = block.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(b)])
        centred = block.crossJoin(F.broadcast(off)).select(F.col("id").alias("c"), *[(F.col(f"v{i}") - F.col(f"m{i}")).alias(f"v{i}") for i in range(b)])  # one row
        return both.join(centred, "c").groupBy("a").agg(*[(F.sum(F.col("d2") * F.col(f"v{i}")) * -0.5).alias(f"w{i}") for i in range(b)])

    return _coordinates(ids, times, n, trace, k, **how)


def jaccard_coordinates(cells: DataFrame, sample: str, feature: str, k: int = 2, size: int | None = None, **how) -> Projection:
    """principal_coordinates of the Jaccard distances of sparse cells (sample, feature).

    Pairs are not written: a round makes the distances of each block of pairs anew from the samples' bits and multiplies them there with the
    broadcast columns of the samples, so what is kept grows with the samples.  Features of several blocks (``size``) go through principal_coordinates.
    """
    from cloneloom.operators.blocks import pair_sums
    from cloneloom.operators.distance import jaccard

    rows = written(cells.where(F.col(sample).isNotNull()).select(F.col(sample).alias("id"), F.col(feature).alias("f")).distinct(), "cells")
    numbered = written(places(rows.select("id").distinct(), "id", "_place").select("id", (F.col("_place") - 1).alias("_at")), "samples")
    n = numbered.count()
    pairs = pair_sums(rows, "id", "f", size=size, carry=rows.groupBy("id").agg(F.count("*").alias("_t")).join(numbered, "id"), later=True) if n > 1 else None
    if pairs is None:
        return principal_coordinates(jaccard(rows, "id", "f"), k, **how)

    def squares(a: pa.Table, b: pa.Table, first: int, end: int, both: np.ndarray) -> np.ndarray:
        t1, t2 = (t.column("_t").to_numpy() for t in (a, b))
        return np.nan_to_num(1 - both / (t1[first:end, None] + t2[None, :] - both)) ** 2

    def times(block: DataFrame, b: int) -> DataFrame:
        found = block.join(numbered, "id").select("_at", *_names(b)).toArrow()  # a row a sample
        values = np.empty((n, b))
        values[found.column("_at").to_numpy()] = np.stack([found.column(c).to_numpy() for c in _names(b)], axis=1)
        sent = block.sparkSession.sparkContext.broadcast(values - values.mean(axis=0))

        def told(a: pa.Table, c: pa.Table, first: int, end: int, both: np.ndarray) -> pa.Table:
            d2 = squares(a, c, first, end, both)
            at1, at2 = (t.column("_at").to_numpy() for t in (a, c))
            out = -0.5 * np.concatenate([d2 @ sent.value[at2], d2.T @ sent.value[at1[first:end]]])
            return pa.table([np.concatenate([at1[first:end], at2]), *out.T], names=["_at", *_names(b, "w")])

        sums = pairs(told, ", ".join(["_at long", *[f"w{i} double" for i in range(b)]])).groupBy("_at").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(b)])
        return sums.join(numbered, "_at").withColumnRenamed("id", "a").drop("_at")

    whole = pairs(lambda *block: pa.table({"s": [float(squares(*block).sum())]}), "s double").agg(F.sum("s")).first()[0]
    return _coordinates(numbered.select("id"), times, n, whole / n, k, **how)


def _coordinates(ids: DataFrame, times: Callable[[DataFrame, int], DataFrame], n: int, trace: float, k: int, **how) -> Projection:
    """Principal coordinates of n samples; times(block, b) gives (a, w0 ...), -1/2 of squared distances times the centred block."""

    def apply(block: DataFrame, b: int) -> DataFrame:
        sums = times(block, b).checkpoint(eager=True)
        block.sparkSession.sparkContext._jvm.System.gc()  # so that the round's shuffle files are deleted
        mean = sums.agg(*[F.avg(f"w{i}").alias(f"m{i}") for i in range(b)])
        return sums.crossJoin(F.broadcast(mean)).select(F.col("a").alias("id"), *[(F.col(f"w{i}") - F.col(f"m{i}")).alias(f"w{i}") for i in range(b)])  # one row

    k = min(k, max(n - 1, 0))
    if not k:
        return Projection(ids.withColumnRenamed("id", "sample"), [], [], 0)
    axes, values, turns = top_eigenvectors(ids, apply, k, n, positive=True, **how)
    scores = axes.select("id", *[(F.col(f"v{i}") * float(np.sqrt(max(values[i], 0.0)))).alias(f"v{i}") for i in range(k)])
    scores = _signed(scores, k).select(F.col("id").alias("sample"), *[F.col(f"v{i}").alias(f"pc{i + 1}") for i in range(k)])
    return Projection(scores, [float(v) for v in values], [float(v) / trace if trace else 0.0 for v in values], turns)


def separation(scores: DataFrame, groups: DataFrame, sample: str, group: str) -> DataFrame:
    """(axis, test, statistic, p): how groups differ along each axis (CL12, CL13).

    Two groups by Mann-Whitney, Kolmogorov-Smirnov and t, more by analysis of variance.  Samples without a group take no part.
    """
    axes = [c for c in scores.columns if c != sample]
    rows = scores.join(groups.where(F.col(group).isNotNull()).select(sample, group), sample).unpivot([sample, group], axes, "axis", "value")
    levels = sorted(r[0] for r in groups.where(F.col(group).isNotNull()).select(group).distinct().limit(3).collect())
    if len(levels) > 2:
        return anova(rows, ["axis"], "value", group).select("axis", F.lit("anova").alias("test"), F.col("f").alias("statistic"), "p")
    two = rows.withColumn("_g", (F.col(group) == F.lit(levels[-1] if levels else 0)).cast("int"))
    tests = ((mann_whitney, "mann_whitney", "u1"), (ks_two_sample, "ks", "d"), (t_test, "t", "t"))
    return reduce(DataFrame.unionByName, [f(two, ["axis"], "value", "_g").select("axis", F.lit(name).alias("test"), F.col(c).cast("double").alias("statistic"), "p") for f, name, c in tests])
