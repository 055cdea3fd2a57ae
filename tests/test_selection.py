"""Folds, searches and nested selection of models."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from cloneloom.operators import selection
from cloneloom.plans import q_selection


@pytest.fixture(scope="module")
def labelled(spark):
    draw = np.random.default_rng(3)
    rows = [(i, int(draw.random() < 0.2) if i % 50 else None, f"g{int(draw.integers(0, 30))}" if i % 97 else None) for i in range(1000)]
    return rows, spark.createDataFrame(rows, "id long, y int, g string").repartition(5)


def test_stratified_folds_keep_class_shares(labelled):
    rows, df = labelled
    got = selection.stratified_folds(df, "id", "y", 7, 5).collect()
    assert sorted(r.id for r in got) == [r[0] for r in rows]
    per = Counter((r.y, r.fold) for r in got)
    for y in (0, 1, None):
        sizes = [per[y, f] for f in range(7)]
        assert max(sizes) - min(sizes) <= 1
    again = selection.stratified_folds(df.repartition(2), "id", "y", 7, 5).collect()
    assert {r.id: r.fold for r in got} == {r.id: r.fold for r in again} != {r.id: r.fold for r in selection.stratified_folds(df, "id", "y", 7, 6).collect()}


def test_group_folds_keep_groups_together(labelled):
    rows, df = labelled
    got = selection.group_folds(df, "g", 4, 1).collect()
    assert len(got) == 1000
    folds = defaultdict(set)
    for r in got:
        folds[r.g].add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    sizes = Counter(r.fold for r in got)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= max(Counter(r[2] for r in rows).values())


def test_leave_one_group_out(labelled):
    rows, df = labelled
    got = selection.leave_one_group_out(df, "g").collect()
    order = sorted({r[2] for r in rows}, key=lambda g: (g is not None, g or ""))
    assert len(got) == 1000 and all(r.fold == order.index(r.g) for r in got)


def test_candidates_are_a_grid_or_drawn():
    spaces = {"logistic": {"regParam": [0.0, 1.0]}, "forest": {"numTrees": [5, 9], "maxDepth": [2, 3]}}
    grid = selection.candidates(spaces)
    assert len(grid) == 6 and len(set(grid)) == 6
    drawn = selection.candidates(spaces, 4, 2)
    assert drawn == selection.candidates(spaces, 4, 2) and len(set(drawn)) == 4 and [c.learner for c in drawn] == ["logistic", "forest"] * 2
    assert set(drawn) <= set(grid) and len(selection.candidates(spaces, 99, 2)) == 6


def planted(spark, n=900, seed=1):
    """y depends on whether two features have the same sign: no line tells."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(int)
    flip = draw.random(n) < 0.05
    rows = [(i, int(b), f"g{i % 25}", *map(float, v)) for i, (b, v) in enumerate(zip(np.where(flip, 1 - y, y), x))]
    return spark.createDataFrame(rows, "id long, y int, g string, x0 double, x1 double, x2 double")


SPACES = {"logistic": {"regParam": [0.01]}, "forest": {"numTrees": [20], "maxDepth": [5]}, "boosted": {"maxIter": [8], "maxDepth": [3]}}


@pytest.mark.parametrize("group", [None, "g"])
def test_trees_win_a_planted_interaction(spark, group):
    df = planted(spark)
    got = selection.nested_selection(df, "id", "y", ["x0", "x1", "x2"], group=group, spaces=SPACES, outer=2, inner=2, n_candidates=None)
    chosen = got.chosen.collect()
    assert [r.fold for r in chosen] == [0, 1] and sum(r.n for r in chosen) == 900
    assert all(r.learner in ("forest", "boosted") and r.score > 0.85 and r.inner_score > 0.8 for r in chosen)
    for r in got.tried.where("learner = 'logistic'").collect():
        assert r.inner_score < 0.65
    scored = got.predictions.collect()
    assert sorted(r.id for r in scored) == list(range(900)) and all(0 <= r.score <= 1 for r in scored)
    if group:
        groups = defaultdict(set)
        for r in scored:
            groups[r.id % 25].add(r.fold)
        assert all(len(f) == 1 for f in groups.values())


def test_a_line_wins_a_planted_line(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 2))
    rows = [(i, float(3 * a - 2 * b + 0.1 * e), float(a), float(b)) for i, ((a, b), e) in enumerate(zip(x, draw.normal(size=400)))] + [(900, None, 1.0, 1.0), (901, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    spaces = {"linear": {"regParam": [0.0]}, "forest": {"numTrees": [10], "maxDepth": [4]}}
    got = selection.nested_selection(df, "id", "y", ["a", "b"], "regression", spaces=spaces, outer=2, inner=2, n_candidates=None)
    assert all(r.learner == "linear" and r.score > 0.98 for r in got.chosen.collect()) and got.predictions.count() == 400


def test_features_are_chosen_on_training_rows(spark):
    df = planted(spark, 300)
    spaces = {"logistic": {"regParam": [0.01], "k_best": [1, 2]}}
    got = selection.nested_selection(df, "id", "y", ["x0", "x1", "x2"], spaces=spaces, outer=2, inner=2, n_candidates=None)
    assert got.tried.count() == 4 and got.predictions.count() == 300


def test_the_query_searches_every_candidate(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(selection, "nested_selection", lambda *_, **how: asked.update(how))
    q_selection._selected(spark, "/root/testdata/sf0.001")
    assert selection.candidates(asked["spaces"], asked["n_candidates"]) == selection.candidates(q_selection.SPACES)
