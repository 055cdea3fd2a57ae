"""All-relevant selection on planted columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.operators import relevance
from cloneloom.plans import catalogue


def planted(spark, n=400):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(n, 12))
    y = (x[:, 0] + 0.8 * x[:, 1] + 0.3 * draw.normal(size=n) > 0).astype(int)
    x[:, 2] = x[:, 0] + 0.05 * draw.normal(size=n)  # says what the first one says: relevant as well
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "k long, y int, " + ", ".join(f"c{i} double" for i in range(12))).repartition(3)


def test_planted_columns_are_confirmed_and_noise_rejected(spark):
    got = {r.column: r for r in relevance.all_relevant(planted(spark), "k", "y", [f"c{i}" for i in range(12)], rounds=14, trees=20, depth=4).collect()}
    assert [got[f"c{i}"].decision for i in range(3)] == ["confirmed"] * 3
    noise = [got[f"c{i}"].decision for i in range(3, 12)]
    assert "confirmed" not in noise and noise.count("rejected") >= 7, noise  # one that agrees with y by chance may stay open


def test_shadows_are_permutations_of_their_columns(spark):
    df = planted(spark, 50)
    got = relevance.with_shadows(df, "k", ["c0", "c1"], 5, 3).orderBy("k").collect()
    values, again = (np.array([r["values"] for r in rows]) for rows in (got, relevance.with_shadows(df, "k", ["c0", "c1"], 5, 3).orderBy("k").collect()))
    assert values.shape == (50, 7) and (values == again).all()
    for k in range(5):
        assert sorted(values[:, 2 + k]) == sorted(values[:, k % 2]) and (values[:, 2 + k] != values[:, k % 2]).any()
    assert (values[:, 2] != values[:, 4]).any()


def test_tests_by_hand():
    assert relevance.at_least(0, 9) == 1 and relevance.at_least(9, 9) == 2**-9 and relevance.at_least(2, 3) == 0.5
    assert relevance.passes_fdr([0.01, 0.04, 0.03, 0.9], 0.05) == [True, False, False, False]
    assert relevance.passes_fdr([0.01, 0.02, 0.03, 0.9], 0.05) == [True, True, True, False]


def test_decisions_by_hand():
    def column(hits, n):
        return relevance._Column("c", hits=hits, rounds=n, p_accept=relevance.at_least(hits, n), p_reject=relevance.at_least(n - hits, n))

    def decided(n, *hits):
        still = [column(h, n) for h in hits]
        relevance.decide(still, n, 0.05)
        return [c.decision for c in still]

    assert decided(7, 7, 0) == ["tentative"] * 2  # 1/128 is over 0.05/7
    assert decided(8, 8, 0, 4) == ["confirmed", "rejected", "tentative"]
    assert decided(20, 17, 5) == ["confirmed", "tentative"]


@pytest.mark.parametrize("rule", ["false", "y = 1"])
def test_nothing_to_tell_apart(spark, rule):
    got = relevance.all_relevant(planted(spark, 30).where(rule), "k", "y", ["c0", "c1"]).select("decision", "rounds").distinct().collect()
    assert [tuple(r) for r in got] == [("tentative", 0)]


def test_rows_with_nulls_take_no_part(spark):
    df = planted(spark, 60)
    more = df.limit(1).select(F.lit(99).alias("k"), "y", F.lit(float("nan")).alias("c0"), "c1", *[f"c{i}" for i in range(2, 12)])
    one = lambda d: [tuple(r) for r in relevance.all_relevant(d, "k", "y", ["c0", "c3"], rounds=1, trees=5, depth=2).collect()]
    assert len(one(df.unionByName(more))) == 2


def test_the_query_goes_on_until_every_column_is_decided(spark, monkeypatch):
    forests = []

    def importances(table, task, trees, depth, seed):
        forests.append((len(table.first()["values"]), trees, depth))
        n = forests[-1][0] // 2
        good = np.arange(n) < (3 if len(forests) % 10 < 7 else 0)  # seven hits in ten rounds
        return np.concatenate([good * 2.0, np.ones(n)])

    monkeypatch.setattr(relevance, "_importances", importances)
    monkeypatch.setattr(relevance, "with_shadows", lambda rows, key, columns, n, seed: rows.limit(1).select(F.array(*[F.lit(0.0)] * (len(columns) + n)).alias("values")))
    monkeypatch.setattr(relevance, "SHADOWS", 0)
    got = catalogue.QUERIES["all_relevant"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.decision for r in got) == ["confirmed"] * 3 + ["rejected"] * 5
    assert len(forests) > 20 and forests[0] == (16, 80, 5)  # as many trees as consider each column about a hundred times


def test_trees_follow_columns():
    assert [relevance.n_trees(n, 5) for n in (1, 8, 50)] == [28, 80, 200] and relevance.n_trees(8, 4) == 100
