"""Block power iteration against dense decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.operators import distance, projection


def angle(a, b):
    """Sine of the largest angle between two sets of columns."""
    a, b = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def test_components_equal_a_dense_decomposition(spark):
    draw = np.random.default_rng(5)
    x = (draw.normal(size=(50, 16)) + 1) * (draw.random((50, 16)) < 0.7) * 0.5 ** np.arange(16)
    x[7] = 0  # a sample without cells
    cells = spark.createDataFrame([(f"s{i:02d}", f"f{j:02d}", float(v)) for (i, j), v in np.ndenumerate(x) if v], "sample string, feature string, v double")
    samples = spark.createDataFrame([(f"s{i:02d}",) for i in range(50)], "sample string")
    got = projection.principal_axes(cells, "sample", "feature", "v", 3, samples)
    assert got.rounds < 12
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    scores = np.array([[r.pc1, r.pc2, r.pc3] for r in got.scores.orderBy("sample").collect()])
    loadings = np.array([[r.pc1, r.pc2, r.pc3] for r in got.loadings.orderBy("feature").collect()])
    for i in range(3):
        assert angle(scores[:, [i]], u[:, [i]]) < 1e-6 and angle(loadings[:, [i]], vt[[i]].T) < 1e-6
        assert scores[np.abs(scores[:, i]).argmax(), i] > 0
    assert got.values == pytest.approx(s[:3] ** 2 / 49) and got.shares == pytest.approx(s[:3] ** 2 / (s**2).sum())
    assert np.linalg.norm(scores, axis=0) == pytest.approx(s[:3])


def test_coordinates_equal_a_dense_decomposition(spark):
    draw = np.random.default_rng(6)
    points = draw.normal(size=(40, 4)) * [5, 3, 1, 0.3]
    d = np.linalg.norm(points[:, None] - points[None], axis=2) + np.abs(draw.normal(size=(40, 40))) * 0.05  # not Euclidean
    d = np.triu(d, 1) + np.triu(d, 1).T
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(i + 1, 40)], "sample1 long, sample2 long, dist double")
    got = projection.principal_coordinates(pairs, 2)
    centre = np.eye(40) - 1 / 40
    b = -0.5 * centre @ (d * d) @ centre
    values, vectors = np.linalg.eigh(b)
    scores = np.array([[r.pc1, r.pc2] for r in got.scores.orderBy("sample").collect()])
    for i in range(2):
        assert angle(scores[:, [i]], vectors[:, [-1 - i]]) < 1e-6
    assert got.values == pytest.approx(values[::-1][:2]) and got.shares == pytest.approx(values[::-1][:2] / np.trace(b))
    assert np.linalg.norm(scores, axis=0) ** 2 == pytest.approx(values[::-1][:2])


def test_low_rank_and_tiny_tables(spark):
    cells = spark.createDataFrame([(f"s{i}", f"f{j}", float((i + 1) * (j + 1))) for i in range(12) for j in range(5)], "s string, f string, v double")
    got = projection.principal_axes(cells, "s", "f", "v", 2)
    assert got.shares == pytest.approx([1, 0], abs=1e-9)
    one = projection.principal_axes(cells.where("s = 's0'"), "s", "f", "v", 2)
    assert one.values == [] and one.scores.count() == 1
    pair = projection.principal_coordinates(spark.createDataFrame([("a", "b", 2.0)], "sample1 string, sample2 string, dist double"), 2)
    assert sorted(r.pc1 for r in pair.scores.collect()) == pytest.approx([-1, 1])


def test_groups_along_axes(spark):
    scores = spark.createDataFrame([(i, float(i % 2) * 5 + i * 0.01, float(i % 7)) for i in range(60)], "sample long, pc1 double, pc2 double")
    groups = scores.select("sample", (F.col("sample") % 2).alias("g"))
    got = {(r.axis, r.test): r.p for r in projection.separation(scores, groups, "sample", "g").collect()}
    assert len(got) == 6 and all(got["pc1", t] < 1e-6 for t in ("mann_whitney", "ks", "t")) and all(got["pc2", t] > 0.3 for t in ("mann_whitney", "ks", "t"))
    more = projection.separation(scores, scores.select("sample", (F.col("sample") % 3).alias("g")), "sample", "g").collect()
    assert {r.test for r in more} == {"anova"} and len(more) == 2


@pytest.mark.parametrize("size", [None, 6])
def test_coordinates_in_blocks_are_those_of_the_pairs(spark, monkeypatch, size):
    draw = np.random.default_rng(5)
    cells = spark.createDataFrame([(f"s{i}", int(f)) for i in range(25) for f in draw.choice(40, 12, replace=False)], "sample string, feature long").repartition(3)
    want = projection.principal_coordinates(distance.jaccard(cells, "sample", "feature"), rounds=4)
    scores = {r["sample"]: (r.pc1, r.pc2) for r in want.scores.collect()}
    if size is None:
        monkeypatch.setattr(projection, "principal_coordinates", None)  # writes a row a pair
    got = projection.jaccard_coordinates(cells, "sample", "feature", size=size, rounds=4)
    assert got.values == pytest.approx(want.values) and got.shares == pytest.approx(want.shares) and got.rounds == 4
    assert len(scores) == 25 and all((r.pc1, r.pc2) == pytest.approx(scores[r["sample"]]) for r in got.scores.collect())
