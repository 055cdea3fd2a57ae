"""Exact subsampling: sums, bounds, distribution, reruns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.operators import sampling


@pytest.mark.parametrize("marked,rest,n", [(5, 7, 4), (30, 3, 20), (1, 40, 10), (6, 6, 12)])
def test_draws_follow_the_distribution(marked, rest, n):
    every = [math.comb(marked, k) * math.comb(rest, n - k) / math.comb(marked + rest, n) if 0 <= n - k <= rest else 0 for k in range(min(n, marked) + 1)]
    got = np.array([sampling.hypergeometric(marked, rest, n, u) for u in (np.arange(20_000) + 0.5) / 20_000])
    assert np.bincount(got, minlength=len(every)) / 20_000 == pytest.approx(every, abs=1e-4)


def test_mean_and_variance_of_a_huge_sample():
    counts = np.array([700_000_000, 900_000_000, 400_000_000, 1_000])
    n, total = 1_000_000, int(counts.sum())
    got = np.array([sampling.divided(counts, n, np.random.default_rng(i)) for i in range(400)])
    assert (got.sum(axis=1) == n).all() and (got <= counts).all() and (got >= 0).all()
    p = counts / total
    sd = np.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
    assert (np.abs(got.mean(axis=0) - n * p) < 5 * sd / 20).all()
    assert got.std(axis=0)[:3] == pytest.approx(sd[:3], rel=0.2)


@pytest.mark.parametrize("size", [8, 4096])
def test_subsample_is_exact(spark, size):
    rows = [("a", f"c{i}", i % 9 + 1) for i in range(200)] + [("b", "one", 3_000_000_000), ("b", "two", 10), ("small", "x", 99), (None, "y", 700), ("a", None, 5), ("a", "c1", 4), ("a", "none", 0)]
    df = spark.createDataFrame(rows, "sample string, clone string, n long")
    got = sampling.subsample(df, "sample", ["clone"], "n", 500, 3, size)
    again = sampling.subsample(df.repartition(7), "sample", ["clone"], "n", 500, 3, size)
    drawn = {(r["sample"], r.clone): r.drawn for r in got.collect()}
    assert drawn == {(r["sample"], r.clone): r.drawn for r in again.collect()}
    have = {(r["sample"], r.clone): r.n for r in df.groupBy("sample", "clone").agg(F.sum("n").alias("n")).collect()}
    assert all(0 < k <= have[c] for c, k in drawn.items()) and ("small", "x") not in drawn
    for s in ("a", "b", None):
        assert sum(k for c, k in drawn.items() if c[0] == s) == 500
    other = {(r["sample"], r.clone): r.drawn for r in sampling.subsample(df, "sample", ["clone"], "n", 500, 4, size).collect()}
    assert other != drawn and sampling.subsample(df.limit(0), "sample", ["clone"], "n", 5).count() == 0
