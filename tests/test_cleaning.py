"""Operators of cleaning, matching, statistics and associations on odd inputs, by hand or by brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.functions import scalars, special
from cloneloom.operators import associations, cleaning, cohort, distance, ml, relational, repertoire, seqmodel, seqsim, stats


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


GROUPS = [("constant", 5.0, 1), ("constant", 5.0, 0), ("constant", 5.0, 1), ("one group", 1.0, 1), ("one group", 2.0, 1), ("large", 1e9, 1), ("large", 1e9 + 1, 1), ("large", 1e9 + 4, 0), ("large", 1e9 + 5, 0), ("single", 3.0, 0), ("nulls", None, 1)]


def test_tests_survive_constant_features_and_empty_groups(spark):
    df = rows(spark, GROUPS, "name string, v double, g int")
    t = {r.name: r for r in stats.t_test(df, ["name"], "v", "g").collect()}
    assert t["constant"].t is None and t["one group"].t is None and t["large"].t == pytest.approx(-4 / math.sqrt(0.5))
    a = {r.name: r for r in stats.anova(df, ["name"], "v", "g").collect()}
    assert a["constant"].f is None and a["one group"].f is None and a["one group"].groups == 1 and a["large"].f == pytest.approx(32)
    k = {r.name: r.d for r in stats.ks_two_sample(df, ["name"], "v", "g").collect()}
    assert k["constant"] == 0 and k["one group"] is None and k["large"] == 1
    c = {r.name: (r.n, r.r) for r in stats.correlations(df, ["name"], "v", "g").collect()}
    assert c["constant"] == (3, None) and c["large"][1] == pytest.approx(-4 / math.sqrt(17), rel=1e-6) and c["single"] == (1, None)
    u = {r.name: r.z for r in stats.mann_whitney(df, ["name"], "v", "g").collect()}
    assert u["one group"] is None


def test_anova_of_values_far_from_zero(spark):
    draw = random.Random(1)
    data = [(i % 3, i % 3 + draw.random()) for i in range(60)]
    f = [stats.anova(rows(spark, [(g, v + shift) for g, v in data], "g int, v double"), [], "v", "g").first()["f"] for shift in (0.0, 1e9)]
    assert f[1] == pytest.approx(f[0], rel=1e-4)
    assert stats.anova(rows(spark, [(0, 1.0), (1, 1.0), (1, 1.0)], "g int, v double"), [], "v", "g").first()["f"] is None


@pytest.mark.parametrize("df", [1, 10, 1e3, 1e5, 1e6, 1e7])
def test_tails_with_many_degrees(df):
    # The chi-square median is about df (1 - 2 / (9 df))**3; F with equal degrees has its median at 1; t tends to the normal.
    assert special.chi2_upper([df * (1 - 2 / (9 * df)) ** 3], [df])[0] == pytest.approx(0.5, abs=0.02 if df < 10 else 1e-3)
    assert special.f_upper([1.0], [df], [df])[0] == pytest.approx(0.5, abs=1e-9)
    assert special.t_two_sided([1.0], [df])[0] == pytest.approx(0.317310508, abs=0.6 / df + 1e-9)


def test_tails_by_known_values():
    assert special.chi2_upper([3.841458821], [1])[0] == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_upper([18.307038], [10])[0] == pytest.approx(0.05, abs=1e-8)
    assert special.t_two_sided([2.228138852], [10])[0] == pytest.approx(0.05, abs=1e-9)
    assert special.f_upper([4.102821], [2], [10])[0] == pytest.approx(0.05, abs=1e-7)
    assert special.t_two_sided([0.0, 40.0], [5, 5])[0] == pytest.approx(1) and special.f_upper([0.0], [3], [4])[0] == pytest.approx(1)


@pytest.mark.parametrize("near", [[("age", 3.0)], [("age", 3.0), ("bmi", 0.5)], [("age", 2.0), ("bmi", 1.0), ("crp", 40.0)], [("age", 0.0)], []])
def test_nearest_match_equals_brute_force(spark, near):
    draw = np.random.default_rng(len(near))
    people = [(i, draw.choice(["m", "f", None], p=[0.5, 0.4, 0.1]), *(None if draw.random() < 0.03 else float(x) for x in (draw.integers(0, 12), draw.normal(), 1000 * draw.random() ** 6))) for i in range(300)]
    people = [(int(i), None if s is None else str(s), *rest) for i, s, *rest in people]
    df = spark.createDataFrame(people, "id long, sex string, age double, bmi double, crp double")
    at = {"sex": 1, "age": 2, "bmi": 3, "crp": 4}
    want = {}
    for a in people[:90]:
        best = None
        for b in people[60:]:  # some cases are in the pool
            if a[0] == b[0] or any(a[at[c]] is None or b[at[c]] is None for c in ("sex", *[n for n, _ in near])) or a[1] != b[1]:
                continue
            if all(abs(a[at[c]] - b[at[c]]) <= most for c, most in near):
                dist = sum(((a[at[c]] - b[at[c]]) / most) ** 2 if most else 0 for c, most in near)
                best = min(best or (dist, b[0]), (dist, b[0]))
        want[a[0]] = best
    got = {r.id: None if r.match is None else (r.dist**2, r.match) for r in cohort.nearest_match(df.where("id < 90"), df.where("id >= 60"), "id", ["sex"], near).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k][1] == v[1] and got[k][0] == pytest.approx(v[0]))


def test_matching_of_cases_within_their_own_pool(spark):
    draw = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "x", float(draw.integers(0, 4))) for i in range(61)], "id long, kind string, age double")
    found = cohort.greedy_match(df, df, "id", ["kind"], [("age", 1.0)]).collect()
    assert len({r.id for r in found}) == len({r.match for r in found}) == len(found) >= 60 and all(r.id != r.match for r in found)


def test_matching_tied_strata_makes_no_pairs(spark):
    """A thousand equal cases and members: a round's join has a row or two for each case."""
    people = spark.range(2000).select("id", F.lit("x").alias("kind"), F.lit(0.0).alias("age"))
    met = cohort.nearest_points(people.where("id < 1000"), cohort._points(people.where("id >= 1000"), "id", ["kind"], [("age", 1.0)]), "id", ["kind"], [("age", 1.0)])
    assert met.count() == 1000 and {r.match for r in met.collect()} == {1000}
    found = cohort.greedy_match(people.where("id < 1000"), people.where("id >= 1000"), "id", ["kind"], [("age", 1.0)], rounds=1)
    assert found.count() == 1000 and found.select("match").distinct().count() == 1000


def test_greedy_matching_of_equal_cases(spark):
    people = rows(spark, [(i, "a", 1.0) for i in range(60)] + [(100 + i, "b", float(i)) for i in range(10)], "id int, kind string, age double")
    cases, pool = people.where("id % 2 = 0"), people.where("id % 2 = 1")
    found = cohort.greedy_match(cases, pool, "id", ["kind"], [("age", 2.0)]).collect()
    assert len({r.id for r in found}) == len({r.match for r in found}) == len(found) and sum(r.id < 100 for r in found) == 30
    free_cases, free_pool = {100 + i for i in range(0, 10, 2)} - {r.id for r in found}, {101 + i for i in range(0, 10, 2)} - {r.match for r in found}
    assert all(abs(a - b) > 2 for a in free_cases for b in free_pool)
    again = cohort.greedy_match(cases, pool, "id", ["kind"], [("age", 2.0)]).collect()
    assert sorted(found) == sorted(again)
    assert cohort.greedy_match(cases.limit(0), pool, "id", ["kind"], [("age", 2.0)]).count() == 0


def test_matching_by_rules(spark):
    people = rows(spark, [(0, "f", 30.0, 20.0), (2, "f", 50.0, 20.0), (4, "m", 30.0, 20.0), (1, "f", 31.0, 21.0), (3, "f", 50.5, 40.0), (5, "x", 30.0, 20.0)], "id int, sex string, age double, bmi double")
    rules = [("sex", "identity", None), ("age", "delta", 2.0), ("bmi", "delta", 3.0)]
    got = {r.id: (r.match, r.rules_used) for r in cohort.matched_by_rules(people.where("id % 2 = 0"), people.where("id % 2 = 1"), "id", rules).collect()}
    assert got == {0: (1, 3), 2: (3, 2)}


def test_running_places_and_quantiles(spark):
    draw = np.random.default_rng(4)
    values = [float(v) for v in draw.integers(0, 3000, 5000)]
    df = rows(spark, [(i, v) for i, v in enumerate(values)], "id int, v double")
    total = {r.id: r.s for r in relational.running(df.withColumn("one", F.lit(1)), [], "v", {"s": "one"}).collect()}
    order = sorted(range(5000), key=lambda i: values[i])
    assert sorted(total.values()) == list(range(1, 5001)) and all(values[a] <= values[b] for a, b in itertools.pairwise(sorted(total, key=total.get)))
    places = {r.id: r.at for r in relational.places(df, "id", "at").collect()}
    assert places == {i: i + 1 for i in range(5000)}
    edges = relational.quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0]).first().edges
    assert edges == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.99, 1]).tolist())
    assert relational.quantiles(df.limit(0), "v", [0.5]).first().edges == [None]
    filled = relational.fill_by_policy(rows(spark, [(1.0, "a"), (None, "b"), (3.0, "b"), (8.0, None)], "x double, k string"), {"x": "median", "k": "mode"})
    assert sorted(map(tuple, filled.collect())) == [(1.0, "a"), (3.0, "b"), (3.0, "b"), (8.0, "b")]
    assert order


@pytest.mark.parametrize("chunk", [3, 1000])
def test_pairs_of_a_hot_key(spark, chunk):
    cells = [(s, k) for s in range(40) for k in ("hot", f"k{s % 7}")]
    got = sorted(map(tuple, repertoire.pairs_within(rows(spark, cells, "s int, k string"), "s", "k", chunk=chunk).select("sample1", "sample2", "k").collect()))
    assert got == sorted((a, b, k) for (a, k), (b, j) in itertools.product(cells, cells) if a < b and k == j)
    every = distance.all_pairs(rows(spark, [(i,) for i in range(30)], "s int"), "s", [], chunk=chunk).count()
    assert every == 30 * 29 // 2


def test_columns_and_outliers(spark):
    df = rows(spark, [(1, 2.0, "a", None), (2, 3.0, "b", None), (3, 900.0, "c", 1.0)], "id int, v_x double, name string, v_rare double")
    assert relational.numeric_columns(df) == ["id", "v_x", "v_rare"]
    assert relational.columns_like(df, contains="_", not_starts="v_r") == ["v_x"] and relational.columns_like(df, ends="e") == ["name", "v_rare"]
    assert relational.drop_sparse_columns(df, 2).columns == ["id", "v_x", "name"]
    low = rows(spark, [(v,) for v in [0.0] * 9 + [-90.0, 90.0]], "v double")
    assert stats.outlier_mask(low, ["v"], 1.5).where("v is null").count() == 2
    assert sorted(r.v for r in stats.outlier_mask(low, ["v"], 1.5, bounds="upper").where("v is not null").collect())[0] == -90
    assert stats.outlier_mask(low, ["v"], 1.5, least=50).where("v is null").count() == 0


def test_correlated_columns_go_by_their_names(spark):
    draw = random.Random(2)
    data = [(x, 2 * x, x + 1, -x, draw.random(), 1.0 if i < 3 else None) for i in range(30) for x in [draw.random()]]
    df = rows(spark, data, "a double, a_T double, a_std double, neg double, b double, rare double")
    assert cleaning.correlated_columns(df, df.columns, 0.99) == ["a", "a_std", "rare"]
    names = rows(spark, [("x", "x_T"), ("x_T", "x"), ("x_0", "x"), ("x", "x_0"), ("x_std", "x"), ("x-1", "x"), ("x", "y")], "a string, b string").coalesce(1)
    assert [r.c for r in names.select(cleaning.loser("a", "b").alias("c")).collect()] == ["x", "x", "x_0", "x_0", "x_std", "x-1", "y"]
    out = cleaning.cleaned(df.withColumn("k", F.lit(3.0)), [*df.columns, "k"], 0.99)
    assert out.columns == ["a_T", "neg", "b"]


def test_metadata_filter_keeps_unknown_values(spark):
    df, meta = rows(spark, [(i,) for i in range(4)], "id int"), rows(spark, [(0, 1, 10), (1, 2, 10), (2, None, 10)], "id int, kind int, reads int")
    assert sorted(r.id for r in cleaning.by_properties(df, meta, "id", {"kind": 1}).collect()) == [1, 2, 3]
    assert sorted(r.id for r in cleaning.by_properties(df, meta, "id", {"kind": 1}, {"reads": 5}).collect()) == [1, 2]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pairs_within_a_distance_equal_brute_force(spark, most):
    draw = random.Random(most)
    seqs = sorted({"".join(draw.choice("AC") for _ in range(draw.randint(1, 9))) for _ in range(90)})
    df = rows(spark, list(enumerate(seqs)), "id int, seq string")

    def padded(a, b):
        return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for found, far in ((seqsim.padded_hamming_within(df, most), padded), (seqsim.levenshtein_within(df, most), edit)):
        want = {(i, j, far(a, b)) for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2) if far(a, b) <= most}
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_windows_across_chunks(spark):
    text = "".join(random.Random(5).choice("abé") for _ in range(3000))
    got = sorted(map(tuple, seqsim.kmers(rows(spark, [(1, text), (2, "ab")], "id int, t string"), "id", "t", 5).collect()))
    assert got == [(1, i, text[i : i + 5]) for i in range(2996)]
    got = seqsim.kmers(rows(spark, [(1, text)], "id int, t string"), "id", "t", 5, step=3).collect()
    assert sorted((r.offset, r.kmer) for r in got) == [(i, text[i : i + 5]) for i in range(0, 2996, 3)]


def test_translation_and_quality(spark):
    df = rows(spark, [("ATGGCCTAAAC", "!I5"), ("ANG", ""), ("AC", "~")], "s string, q string")
    got = df.select(seqsim.translated("s").alias("t"), seqsim.phred_scores("q").alias("p")).collect()
    assert [r.t for r in got] == ["MA*", "X", ""] and [r.p for r in got] == [[0, 40, 20], [], [93]]


def test_insertions_by_combination(spark):
    data = [("ACGTACGT", 1, 4, 5, 8, "v"), ("ACGTACGA", 1, 4, None, 8, "v"), ("TTTT", 2, 2, 0, 2, "w")]
    df = rows(spark, data, "nucleotide string, n1Index int, dIndex int, n2Index int, jIndex int, g string")
    assert sorted((r.nucleotide, r.insertion, r.insertion_length) for r in seqmodel.insertions(df).collect()) == [("ACGTACGA", "CGT", 3), ("ACGTACGT", "CGT", 3), ("TTTT", "", 0)]
    got = seqmodel.insertions(df, "ins2", "combination", ["g"]).collect()
    assert sorted((r.nucleotide, r.insertion, r.insertion_length) for r in got) == [("ACGTACGA", None, 0), ("TTTT", "AA", 2)]


def test_prior_counts(spark):
    assert all(set(own) == set("ACGT") for own in seqmodel.FIRST_PRIORS.values()) and all(set(own) == set("ACGT") and all(set(x) == set("ACGT") for x in own.values()) for own in seqmodel.MOVE_PRIORS.values())
    counts = rows(spark, [(1, "A", "C", 3)], "length int, previous string, letter string, n long")
    got = {(r.previous, r.letter): r.p for r in seqmodel.with_prior(counts, ["length", "previous"], seqmodel.MOVE_PRIORS["weak differ"]).collect()}
    assert got["A", "C"] == pytest.approx(6 / 13) and got["C", "C"] == pytest.approx(5 / 11) and len(got) == 16


def test_linear_model_equals_least_squares(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(80, 2))
    y = 2 + x @ [1.5, -0.5] + draw.normal(size=80) * 0.3
    got = {r.feature: r for r in ml.linear_p_values(rows(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"]).collect()}
    full = np.column_stack([x, np.ones(80)])
    w, rest, *_ = np.linalg.lstsq(full, y, rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rest[0] / 77)
    for name, c, e in zip(("a", "b", "intercept"), w, errors):
        assert got[name].coefficient == pytest.approx(c) and got[name].error == pytest.approx(e)
        assert got[name].p == pytest.approx(special.t_two_sided([c / e], [77])[0], abs=1e-9)


def test_nested_logistic_gains(spark):
    draw = random.Random(4)
    data = [(int(x + draw.gauss(0, 1) > 0), x, draw.random()) for x in (draw.gauss(0, 1) for _ in range(400))]
    got = ml.nested_logistic(rows(spark, data, "y int, x double, noise double"), "y", ["x", "noise"]).collect()
    assert got[0].p < 1e-6 and got[0].pseudo_r2 > 0.2 and got[1].p > 0.01 and got[1].deviance <= got[0].deviance and got[1].gain < 0.01


def test_models_of_healthy_people(spark):
    draw = random.Random(5)
    data = [(i, int(x > 0), x) for i in range(200) for x in [draw.gauss(0, 1)]]
    df = rows(spark, data, "id int, y int, x double")
    scores = {r.id: r.score for r in ml.averaged_models(df.where("id < 150"), df.where("id >= 150"), "id", "y", ["x"]).collect()}
    assert set(scores) == set(range(150, 200)) and all((scores[i] > 0.5) == bool(y) for i, y, x in data[150:] if abs(x) > 0.3)


def test_permutation_tests_find_structure(spark):
    groups = rows(spark, [(i, i % 2) for i in range(24)], "sample int, g int")
    pairs = rows(spark, [(a, b, 0.1 + 0.01 * ((a * 7 + b) % 5) if a % 2 == b % 2 else 0.9) for a in range(24) for b in range(a + 1, 24)], "sample1 int, sample2 int, dist double")
    got = associations.permanova_p(pairs, groups, "sample", "g").first()
    plain = distance.permanova_f(pairs, groups, "sample", "g").first()
    assert got.f == pytest.approx(plain.f) and got.p == pytest.approx(1 / 101) and got.n_perms == 100
    same = associations.mantel_p(pairs, pairs).first()
    assert same.r == pytest.approx(1) and same.p == pytest.approx(1 / 101)


def test_pair_correlations_equal_dense_ones(spark):
    draw = np.random.default_rng(6)
    x, y = draw.random((30, 3)) * (draw.random((30, 3)) > 0.4), draw.integers(0, 4, (30, 2)).astype(float)
    x[:, 2], y[:, 1] = 1.0, np.where(np.arange(30) % 3 > 0, 2.0, 0.0)
    cells = lambda m, v: [(int(s), f"f{j}", float(m[s, j])) for s in range(30) for j in range(m.shape[1])] + [(99 if v == "v1" else 98, "f0", 1.0)]
    a, b = rows(spark, cells(x, "v1"), "s int, f1 string, v1 double"), rows(spark, cells(y, "v2"), "s int, f2 string, v2 double")

    def ranks(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    for method, f in (("pearson", lambda v: v), ("spearman", ranks)):
        got = {(r.f1, r.f2): r for r in associations.pair_correlations(a, b, "s", "f1", "v1", "f2", "v2", method, 0.0).collect()}
        assert len(got) == 6
        for i in range(3):
            for j in range(2):
                r = got[f"f{i}", f"f{j}"]
                assert r.n == 30
                if x[:, i].std() == 0:
                    assert r.r is None or math.isnan(r.r)
                else:
                    assert r.r == pytest.approx(np.corrcoef(f(x[:, i]), f(y[:, j]))[0, 1])


def test_scalar_dates_and_numbers(spark):
    df = rows(spark, [("1974", 80.0, 180.0, 2010, "S2017x"), ("15", 80.0, 1.8, 2020, "none"), ("x", None, 0.0, 2000, None)], "b string, w double, h double, y int, n string")
    got = df.select(scalars.age_from("b", "y").alias("age"), scalars.body_mass_index("w", "h").alias("bmi"), scalars.years_since("n").alias("since")).collect()
    assert [r.age for r in got] == [36, 5, None] and got[0].bmi == pytest.approx(got[1].bmi) == pytest.approx(24.691358) and got[2].bmi is None
    assert [r.since for r in got] == ["17x", None, None]
    df = rows(spark, [("a,b", "b,c"), ("a", "b")], "x string, y string").select(F.split("x", ",").alias("x"), F.split("y", ",").alias("y"))
    assert [r[0] for r in df.select(scalars.any_common("x", "y")).collect()] == [1, 0] or [bool(r[0]) for r in df.select(scalars.any_common("x", "y")).collect()] == [True, False]


def test_signed_log_and_enrichment(spark):
    df = rows(spark, [(0.01, 1), (0.001, -1), (0.0, 1)], "p double, d int")
    assert [r[0] for r in df.select(stats.signed_log_p("p", "d")).collect()] == pytest.approx([2, -3, 300])
