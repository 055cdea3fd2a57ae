"""Shapley values against brute force over all subsets of features."""

import itertools
import math

import numpy as np
import pytest

from cloneloom.operators import attribution

FEATURES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 6)).round(2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    return spark.createDataFrame([(i, float(b), *map(float, v)) for i, (b, v) in enumerate(zip(y, x))], "id long, y double, " + ", ".join(f"{f} double" for f in FEATURES))


def expected(nodes, row, known):
    """The mean score of a tree when only some features are known."""

    def at(i):
        node = nodes[i]
        if node["left"] < 0:
            return node["value"]
        left, right = nodes[node["left"]], nodes[node["right"]]
        if node["feature"] in known:
            return at(node["left"] if row[node["feature"]] <= node["threshold"] else node["right"])
        return (left["cover"] * at(node["left"]) + right["cover"] * at(node["right"])) / node["cover"]

    return at(0)


def brute(trees, row):
    def v(known):
        return sum(w * expected(nodes, row, known) for w, nodes in trees)

    out = []
    for j in range(6):
        rest = [i for i in range(6) if i != j]
        out.append(sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (v({*s, j}) - v(set(s))) for k in range(6) for s in itertools.combinations(rest, k)))
    return v(set()), out


@pytest.mark.parametrize("tabled", [10, 1])
@pytest.mark.parametrize("kind", ["RandomForestClassifier", "GBTClassifier", "DecisionTreeClassifier", "RandomForestRegressor", "GBTRegressor", "DecisionTreeRegressor"])
def test_tree_values_equal_brute_force(spark, table, monkeypatch, kind, tabled):
    from pyspark.ml import classification, regression
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(attribution, "TABLED", tabled)
    learner = getattr(classification, kind, None) or getattr(regression, kind)
    made = learner(labelCol="y", maxDepth=4, seed=1) if tabled == 10 else learner(labelCol="y", maxDepth=3, seed=1)
    for name, n in (("numTrees", 4), ("maxIter", 3)):
        if made.hasParam(name):
            made = made.copy({made.getParam(name): n})
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = made.fit(rows)
    nodes = attribution.node_table(model).collect()
    trees = [(ns[0]["weight"], {r["id"]: r for r in ns}) for t in sorted({r["tree"] for r in nodes}) if (ns := [r for r in nodes if r["tree"] == t])]
    got = {r.id: r for r in attribution.tree_shapley(table, "id", model, FEATURES).collect()}
    assert len(got) == 400
    for r in got.values():
        assert r.base + sum(r.shap) == pytest.approx(r.score, abs=1e-9)
    for r in table.where("id < 6").collect():
        base, values = brute(trees, [r[f] for f in FEATURES])
        assert got[r.id].base == pytest.approx(base) and got[r.id].shap == pytest.approx(values, abs=1e-9)
    if "Classif" in kind:
        probability = {r.id: r.probability[1] for r in model.transform(rows).select("id", "probability").collect()}
        for i, r in got.items():
            assert probability[i] == pytest.approx(1 / (1 + math.exp(-2 * r.score)) if kind.startswith("GBT") else r.score, abs=1e-9)
    else:
        assert {r.id: r.prediction for r in model.transform(rows).collect()} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)


def test_a_tree_of_one_leaf(spark, table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table.where("y = 1"))
    got = attribution.tree_shapley(table, "id", DecisionTreeRegressor(labelCol="y").fit(rows), FEATURES).collect()
    assert all((r.base, r.score, r.shap) == (1, 1, [0] * 6) for r in got) and len(got) == 400


def test_linear_values_and_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, None), (3, 5.0, 30.0)], "id long, a double, b double")
    got = attribution.linear_shapley(df, "id", {"a": 2.0, "b": -0.1})
    assert {(r.id, r.feature): r.shap for r in got.collect()} == pytest.approx({(1, "a"): -4, (2, "a"): 0, (3, "a"): 4, (1, "b"): 1, (2, "b"): 0, (3, "b"): -1})
    ranks = attribution.ranked_features(got).collect()
    assert [(r.feature, r.total, r.direction, r.place) for r in sorted(ranks, key=lambda r: r.place)] == [("a", 8, 1, 1), ("b", 2, -1, 2)]
    assert [r.feature for r in attribution.ranked_features(got, 1).collect()] == ["a"]


def test_long_values(spark, table):
    shap = spark.createDataFrame([(1, [0.5] * 6), (2, [1.0] * 6)], "id long, shap array<double>")
    got = attribution.long_values(shap, table, "id", FEATURES).collect()
    own = {r.id: r for r in table.where("id in (1, 2)").collect()}
    assert len(got) == 12 and all(r.value == own[r.id][r.feature] and r.shap == r.id / 2 for r in got)
