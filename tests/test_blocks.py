"""Sums and permutation tests of pairs against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.functions import special
from cloneloom.operators import associations, blocks, distance, ml


@pytest.fixture(scope="module")
def cells(spark):
    draw = np.random.default_rng(7)
    rows = sorted({(f"s{int(draw.integers(0, 30))}", int(draw.integers(0, 90))) for _ in range(500)} | {(f"s{i}", 5) for i in range(30)})
    return spark.createDataFrame([(s, f, float(draw.integers(1, 9)) / 4) for s, f in rows], "sample string, feature long, v double").repartition(3)


@pytest.mark.parametrize("chunk,size", [(4, 16), (7, 1 << 19), (100, 6)])
@pytest.mark.parametrize("value", [None, "v"])
def test_pair_sums_equal_brute_force(cells, chunk, size, value):
    by = defaultdict(dict)
    for r in cells.collect():
        by[r["sample"]][r.feature] = r.v if value else 1
    want = {(a, b): t for a in by for b in by if a < b and (t := sum(min(v, by[b][f]) for f, v in by[a].items() if f in by[b]))}
    got = {(r.sample1, r.sample2): r.total for r in blocks.pair_sums(cells, "sample", "feature", value, chunk, size).collect()}
    assert got == pytest.approx(want)


def test_pair_sums_of_numbers_and_empty_tables(spark, cells):
    numbers = spark.createDataFrame([(3, "x"), (1, "x"), (2, "x"), (1, "y")], "s int, f string")
    got = blocks.pair_sums(numbers, "s", "f")
    assert dict(got.dtypes) == {"sample1": "int", "sample2": "int", "total": "bigint"}
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]
    assert blocks.pair_sums(cells.limit(0), "sample", "feature").count() == 0


def test_permutations_are_those_of_permuted_labels(spark):
    names = [f"n{i:02d}" for i in range(23)]
    src = blocks.permutations(names, 4, 9, 2)
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "k string, y int")
    got = {(r.perm, r.k): r.y for r in ml.permuted_labels(df, "k", "y", 5, 9).collect()}
    assert all(got[p, n] == src[p - 2, i] for p in (2, 3, 4, 5) for i, n in enumerate(names))


def test_fisher_bounds_of_all_small_tables():
    for n in (6, 9, 14):
        for k1 in range(n + 1):
            for k2 in range(n + 1):
                ways = {a: math.comb(k1, a) * math.comb(n - k1, k2 - a) for a in range(max(0, k1 + k2 - n), min(k1, k2) + 1)}
                for a in ways:
                    low, high = special.fisher_bounds(np.array([a]), np.array([k1]), np.array([k2]), n)
                    assert [w <= ways[a] for w in ways.values()] == [x <= low[0] or x >= high[0] for x in ways]


@pytest.mark.parametrize("statistic", blocks.STATISTICS)
@pytest.mark.parametrize("chunk,perm_bytes", [(256, 32 << 20), (5, 4 * 30 * 7)])
def test_pair_permutations_equal_brute_force(spark, cells, statistic, chunk, perm_bytes):
    draw = np.random.default_rng(2)
    species = spark.createDataFrame([(f"s{i}", f"p{k}", float(draw.integers(1, 6))) for i in range(2, 33) for k in range(6) if draw.random() < 0.15 * (k + 1)] + [(f"s{i}", "all", 1.0) for i in range(33)], "sample string, species string, w double")
    n_perms = 20
    got = blocks.pair_permutation_test(cells.where("feature < 25"), species, "sample", "feature", "species", statistic, "v", "w", n_perms=n_perms, seed=3, chunk=chunk, perm_bytes=perm_bytes).collect()
    names = sorted({r["sample"] for r in cells.where("feature < 25").collect()} & {r["sample"] for r in species.collect()})
    dense = lambda df, f, v: {k: np.array([dict(m).get(s, 0.0) for s in names]) for k, m in _by(df, f, v).items()}
    x, y = dense(cells.where("feature < 25"), "feature", "v"), dense(species, "species", "w")
    src = blocks.permutations(names, n_perms, 3)
    assert len(got) == len(x) * len(y)
    for r in got:
        a, b = x[r.feature], y[r.species]
        real, null = _statistic(statistic, a, b), [_statistic(statistic, a, b[s]) for s in src]
        if real is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx((1 + sum(v >= real - 1e-9 for v in null)) / (1 + n_perms)) and r.n_perms == n_perms
        if statistic in ("odds", "fisher"):
            assert (r.a, r.b, r.c, r.d) == tuple(int(((a > 0) == p).astype(int) @ ((b > 0) == q)) for p, q in ((True, True), (True, False), (False, True), (False, False)))


def _by(df, feature, value):
    out = defaultdict(list)
    for r in df.collect():
        out[r[feature]].append((r["sample"], r[value]))
    return out


def _statistic(kind, x, y):
    if kind in ("pearson", "spearman"):
        if kind == "spearman":
            x, y = (np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v]) for v in (x, y))
        return None if x.std() == 0 or y.std() == 0 else abs(np.corrcoef(x, y)[0, 1])
    p, q = x > 0, y > 0
    a, b, c, d = (p & q).sum(), (p & ~q).sum(), (~p & q).sum(), (~p & ~q).sum()
    if kind == "odds":
        if a * d == 0 and b * c == 0:
            return None
        return math.inf if a * d == 0 or b * c == 0 else abs(math.log(a * d / (b * c)))
    return -special.fisher_two_sided([a], [b], [c], [d])[0]


def test_samples_without_cells_count(spark, cells):
    every = spark.range(60).select(F.concat(F.lit("s"), "id").alias("sample"))
    labels = every.where("substring(sample, 2) % 2 = 0").withColumn("label", F.lit("even"))
    got = blocks.pair_permutation_test(cells, labels, "sample", "feature", "label", "fisher", samples=every, n_perms=10).collect()
    assert all(r.n == 60 and r.a + r.b + r.c + r.d == 60 and r.a + r.c == 30 for r in got) and len(got) == cells.select("feature").distinct().count()


@pytest.mark.parametrize("value", [None, "v"])
@pytest.mark.parametrize("size", [None, 6])
def test_every_pair_carries_columns_and_is_not_shuffled(spark, cells, value, size):
    names = spark.createDataFrame([(f"s{i}", i, None if i == 3 else f"g{i % 2}") for i in range(40)], "sample string, k int, g string")  # ten have no cells
    pairs = blocks.pair_sums(cells, "sample", "feature", value, 7, size, carry=names)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString() + pairs._jdf.queryExecution().executedPlan().toString()
    assert size or ("CartesianProduct" in plan and "Exchange" not in plan)
    got = {(r.sample1, r.sample2): (r.total, r.k1, r.k2, r.g1, r.g2) for r in pairs.collect()}
    known = {(r.sample1, r.sample2): r.total for r in blocks.pair_sums(cells, "sample", "feature", value).collect()}
    of = {r["sample"]: r for r in names.collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), r in got.items():
        assert a < b and r == (pytest.approx(known.get((a, b), 0)), of[a].k, of[b].k, of[a].g, of[b].g)


def test_both_distances_are_those_of_one_at_a_time(spark, cells):
    both = {(r.sample1, r.sample2): (r.dist, r.dist2) for r in distance.both_distances(cells, "sample", "feature", "v").collect()}
    one = {(r.sample1, r.sample2): r.dist for r in distance.jaccard(cells, "sample", "feature").collect()}
    two = {(r.sample1, r.sample2): r.dist for r in distance.bray_curtis(cells, "sample", "feature", "v").collect()}
    assert {k: v[0] for k, v in both.items()} == pytest.approx(one) and {k: v[1] for k, v in both.items()} == pytest.approx(two)


@pytest.mark.parametrize("perm_bytes", [32 << 20, 4 * 33 * 7])
def test_mantel_sums_in_blocks_are_those_of_joined_pairs(spark, cells, monkeypatch, perm_bytes):
    more = cells.unionByName(spark.createDataFrame([("t1", 1000, 2.0), ("t2", 1001, 0.5), ("t3", 7, 0.0)], cells.schema))  # two share nothing
    whole = associations.mantel_p(distance.jaccard(more, "sample", "feature"), distance.bray_curtis(more, "sample", "feature", "v"), 20, 3).first()
    monkeypatch.setattr(blocks, "PERM_BYTES", perm_bytes)
    apart = associations.mantel_distances(more, "sample", "feature", "v", 20, 3, size=6).first()  # columns of several blocks
    monkeypatch.setattr(associations, "permuted_labels", None)  # a row for each pair and permutation
    got = associations.mantel_distances(more, "sample", "feature", "v", 20, 3).first()
    for r in (got, apart):
        assert (r.n, r.p, r.n_perms) == (whole.n, whole.p, 20) and r.r == pytest.approx(whole.r, abs=1e-9)


def test_common_ones_are_counted_in_pieces(monkeypatch):
    draw = np.random.default_rng(1)
    dense = draw.random((23, 300)) < 0.4, draw.random((11, 300)) < 0.4
    monkeypatch.setattr(blocks, "PAIRS", 40)
    assert (blocks._both(*map(blocks._bits, dense)) == dense[0].astype(int) @ dense[1].T.astype(int)).all()


@pytest.mark.parametrize("size", [None, 6])
def test_sums_of_two_distances_are_those_of_their_pairs(spark, cells, monkeypatch, size):
    more = cells.unionByName(spark.createDataFrame([("t1", 1000, 2.0), ("t2", 1001, 0.5), ("t3", 7, 0.0)], cells.schema))
    want = distance.mantel_r(distance.both_distances(more, "sample", "feature", "v"), None).first()
    if size is None:
        monkeypatch.setattr(distance, "both_distances", None)  # a row a pair
    got = distance.mantel_both(more, "sample", "feature", "v", size).first()
    assert got.n == want.n == 33 * 32 // 2 and got.r == pytest.approx(want.r, abs=1e-12)


@pytest.mark.parametrize("size", [None, 6])
def test_classes_of_pairs_are_counted_in_blocks(spark, cells, size):
    flags = spark.createDataFrame([(f"s{i}", None if i == 3 else i % 2) for i in range(2, 40)], "sample string, cohort int")
    pairs = distance.pair_classes(blocks.pair_sums(cells, "sample", "feature").withColumnRenamed("total", "n_shared"), flags, "sample", "cohort")
    want = {(r.n_flagged, r.n_shared): r["count"] for r in pairs.where("n_flagged is not null").groupBy("n_flagged", "n_shared").count().collect()}
    counts = associations.shared_class_counts(cells, flags, "sample", "feature", "cohort", size)
    assert {(r.n_flagged, r.n_shared): r.n for r in counts.collect()} == want
    values = {k: np.repeat(*np.array([(v, n) for (g, v), n in want.items() if g == k]).T).astype(float) for k in (0, 2)}
    got = associations.pair_class_tests(counts, "n_shared", weight="n").first()
    a, b = values[0], values[2]
    pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    gap = max(abs((a <= v).mean() - (b <= v).mean()) for v in {*a, *b})
    assert (got.n1, got.n2) == (len(b), len(a))
    assert (got.mean_a, got.mean_b, got.d, got.t) == pytest.approx((a.mean(), b.mean(), gap, (b.mean() - a.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))))
