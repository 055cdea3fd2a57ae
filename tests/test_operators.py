"""Operators on literals worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloneloom.functions import scalars, special
from cloneloom.operators import cohort, distance, ml, relational, repertoire, seqsim, stats


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_diversity_of_1_1_2(spark):
    df = rows(spark, [("s", "a", 1), ("s", "b", 1), ("s", "c", 2)], "sample string, clone string, n int")
    r = repertoire.diversity(df, "sample", "clone", "n").first()
    assert (r.shannon, r.simpson, r.berger_parker, r.richness) == (1.5, 0.625, 0.5, 3)


def test_expected_richness(spark):
    df = rows(spark, [("s", "a", 2), ("s", "b", 1), ("s", "c", 1)], "sample string, clone string, n long")
    assert repertoire.expected_richness(df, "sample", "n", 2).first().expected == pytest.approx(1.833333, abs=1e-6)
    assert repertoire.expected_richness(df, "sample", "n", 5).first().expected is None


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 7.5, 100.0, 1e6, 1e12]
    got = [r[0] for r in rows(spark, [(x,) for x in xs], "x double").select(repertoire.log_gamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10)


def test_fisher_and_odds_ratio(spark):
    df = rows(spark, [(8, 2, 1, 5), (0, 0, 3, 4), (3, 0, 0, 3)], "a int, b int, c int, d int")
    got = stats.fisher_exact(df, "a", "b", "c", "d").orderBy(F.desc("a")).collect()
    assert got[0].p == pytest.approx(0.034965, abs=1e-6) and got[0].odds_ratio == pytest.approx(20)
    assert got[1].p == pytest.approx(0.1) and got[1].odds_ratio == 999999
    assert got[2].p == pytest.approx(1)
    ci = stats.odds_ratio_ci(df, "a", "b", "c", "d").where("a = 8").first()
    half = 1.96 * math.sqrt(1 / 8 + 1 / 5 + 1 / 2 + 1)
    assert ci.ci_low == pytest.approx(math.exp(math.log(20) - half)) and ci.significant == (ci.ci_low > 1)


def brute_fisher(a, b, c, d):
    ways = lambda k: math.comb(a + b, k) * math.comb(c + d, a + c - k)
    every = [ways(k) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
    return sum(w for w in every if w <= ways(a)) / sum(every)


def test_fisher_of_all_small_tables_and_huge_ones():
    cells = [(a, b, c, d) for a in range(7) for b in range(6) for c in range(7) for d in range(6)] + [(40, 3, 20, 90), (0, 900, 4, 100), (300, 280, 310, 300), (1, 1000, 1000, 1)]
    got = special.fisher_two_sided(*zip(*cells))
    assert got == pytest.approx([brute_fisher(*x) for x in cells], rel=1e-9, abs=1e-300)
    huge = special.fisher_two_sided([50_000_000, 50_003_000], [50_000_000, 50_000_000], [50_000_000, 50_000_000], [50_000_000, 50_003_000])
    z = 6000 / math.sqrt(200_006_000)  # so large that the normal approximation holds
    assert huge[0] == 1 and huge[1] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_null_labels_take_no_part(spark):
    cells = rows(spark, [(i, "f", float(i + 1)) for i in range(10)], "sample int, feature string, v double")
    samples = rows(spark, [(i, 1 if i < 4 else 0 if i < 8 else None) for i in range(10)], "sample int, g int")
    r = stats.binary_association(cells, samples, "sample", "feature", "v", "g").first()
    assert (r.present1, r.absent1, r.present0, r.absent0, r.mean1, r.mean0, r.u1) == (4, 0, 4, 0, 2.5, 6.5, 0)
    assert r.p_fisher == 1 and r.p_mw == pytest.approx(0.0303828, abs=1e-6)


def test_shuffles_without_a_statistic_do_not_count(spark):
    real, null = rows(spark, [("a", 2.0), ("b", 2.0)], "k string, s double"), rows(spark, [("a", 3.0), ("a", None), ("a", None), ("b", None)], "k string, s double")
    assert {r.k: (r.p, r.n_perms) for r in ml.permutation_p(real, null, ["k"], "s").collect()} == {"a": (1.0, 1), "b": (1.0, 0)}


def test_places_in_an_order_of_several_columns(spark):
    draw = np.random.default_rng(4)
    data = [(float(draw.integers(0, 5)) if draw.random() > 0.1 else None, f"n{i}") for i in range(500)]
    df = rows(spark, data, "v double, name string").withColumn("o", F.struct("v", "name"))
    got = {r["name"]: r.place for r in relational.places(df, "o", "place").collect()}
    assert got == {n: i for i, (_, n) in enumerate(sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), 1)}


def test_adjusted_p(spark):
    df = rows(spark, [(0.01,), (0.04,), (0.03,), (0.005,), (None,)], "p double")
    bh = {r.p: r.p_adjusted for r in stats.adjusted(df, "p", "bh").collect()}
    assert bh == {0.01: pytest.approx(0.02), 0.04: pytest.approx(0.04), 0.03: pytest.approx(0.04), 0.005: pytest.approx(0.02), None: None}


def test_mann_whitney(spark):
    df = rows(spark, [(v, 1) for v in (1, 2, 3)] + [(v, 0) for v in (4, 5, 6)], "v int, g int")
    r = stats.mann_whitney(df, [], "v", "g").first()
    assert (r.u1, r.u2) == (0, 9) and r.p == pytest.approx(0.0808556, abs=1e-6)
    assert stats.mann_whitney(df, [], "v", "g", "legacy").first().p == pytest.approx(0.0404278, abs=1e-6)


def test_tail_probabilities():
    assert special.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)
    assert special.t_two_sided([2.228139], [10])[0] == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper([4.102821], [2], [10])[0] == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper([3.841459, 18.307038], [1, 10]) == pytest.approx([0.05, 0.05], abs=1e-6)
    assert special.ks_asymptotic([0.5], [100], [100])[0] < 1e-8
    assert special.lgamma([0.5, 10.0]) == pytest.approx([math.lgamma(0.5), math.lgamma(10)])


def test_string_distances(spark):
    df = rows(spark, [("CASSLG", "CASSLGQ"), ("CASSLG", "ACASSLG")], "a string, b string")
    assert [r[0] for r in df.select(seqsim.padded_hamming("a", "b")).collect()] == [1, 6]


def test_blocked_pairs_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    seqs = sorted({"".join(draw.choice(list("ACG"), draw.integers(1, 6))) for _ in range(120)})
    df = rows(spark, list(enumerate(seqs)), "id long, seq string")
    hamming = lambda a, b: sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
    want = {(i, j) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if i < j and hamming(a, b) <= 1}
    assert {(r.seq1id, r.seq2id) for r in seqsim.padded_hamming_pairs(df).collect()} == want

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(i, j) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if i < j and lev(a, b) <= 1}
    assert {(r.seq1id, r.seq2id) for r in seqsim.levenshtein_pairs(df).collect()} == want


def test_searches_with_mismatches_equal_brute_force(spark):
    draw = np.random.default_rng(8)
    texts = [(i, "".join(draw.choice(list("AC"), int(draw.integers(0, 60))))) for i in range(12)] + [(50, "".join(draw.choice(list("AC"), 1300))), (51, None), (52, "")]
    patterns = [("".join(draw.choice(list("AC"), 9)),) for _ in range(6)] + [("ACACACACA",), ("AAAA",), (None,), ("ACACACACA",)]
    a, b = rows(spark, texts, "id long, t string"), rows(spark, patterns, "p string")

    def brute(most, seeds=None):
        out = set()
        for i, t in texts:
            for (p,) in patterns:
                for s in range(len(t or "") - 8):
                    if p and len(p) == 9 and (n := sum(x != y for x, y in zip(t[s : s + 9], p))) <= most and (not seeds or any(t[s + r : s + 9 : seeds] == p[r::seeds] for r in range(seeds))):
                        out.add((i, p, s, n))
        return out

    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(seqsim.approximate_matches(a, "id", "t", b, "p", 9, 2)) == sorted(brute(2))
    assert got(seqsim.spaced_matches(a, "id", "t", b, "p", 9, 2, 3)) == sorted(brute(2))
    assert got(seqsim.spaced_matches(a, "id", "t", b, "p", 9, 4, 2)) == sorted(brute(4, 2)) != sorted(brute(1))
    # Every second letter differs: no run of two letters fits, a phase does.
    far = rows(spark, [(1, "ACACACACA")], "id long, t string"), rows(spark, [("AAAAAAAAA",)], "p string")
    assert got(seqsim.spaced_matches(far[0], "id", "t", far[1], "p", 9, 4, 2)) == [(1, "AAAAAAAAA", 0, 4)]
    assert {(r.offset, r.kmer) for r in seqsim.spaced_kmers(far[0], "id", "t", 3, 2).collect()} == {(0, "AAA"), (1, "CCC"), (2, "AAA"), (3, "CCC"), (4, "AAA")}


def test_set_distances(spark):
    cells = rows(spark, [("x", "a", 1.0), ("x", "b", 2.0), ("y", "b", 2.0), ("y", "c", 2.0)], "s string, f string, v double")
    assert distance.jaccard(cells, "s", "f").first().dist == pytest.approx(2 / 3)
    assert distance.bray_curtis(cells, "s", "f", "v").first().dist == pytest.approx(3 / 7)


def test_venn_regions(spark):
    data = [(i, "a") for i in range(10)] + [(i, "b") for i in range(5, 15)] + [(i, "c") for i in range(3, 8)]
    got = {r.region: r.n for r in relational.venn_regions(rows(spark, data, "x int, g string"), "x", "g", ["a", "b", "c"]).collect()}
    assert got == {"001": 0, "010": 5, "011": 0, "100": 3, "101": 2, "110": 2, "111": 3}


def test_downsample_is_exact(spark):
    df = rows(spark, [("s", i, i % 7 + 1) for i in range(60)] + [("t", 1, 3)], "sample string, clone int, n int")
    got = repertoire.downsample(df, "sample", ["clone"], "n", 50, 1).collect()
    assert sum(r.drawn for r in got) == 50 and {r["sample"] for r in got} == {"s"}
    assert all(r.drawn <= r.clone % 7 + 1 for r in got)


def test_pivot_refuses_repeated_cells(spark):
    df = rows(spark, [(1, "a", 2.0), (1, "a", 3.0)], "k int, c string, v double")
    with pytest.raises(Exception, match="repeated cell"):
        relational.pivot_unique(df, "k", "c", "v", ["a"]).collect()


def test_auc_with_ties(spark):
    df = rows(spark, [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert ml.evaluate_binary(df, [], "y", "s").first().roc_auc == pytest.approx(0.875)


def test_permutations_keep_labels(spark):
    df = rows(spark, [(i, int(i < 4)) for i in range(20)], "k long, y int")
    got = ml.permuted_labels(df, "k", "y", 6, 2).groupBy("perm").agg(F.sum("y").alias("n"), F.count("*").alias("k")).collect()
    assert len(got) == 6 and all((r.n, r.k) == (4, 20) for r in got)


def test_greedy_match_uses_members_once(spark):
    people = rows(spark, [(i, "m" if i % 2 else "f", float(20 + i)) for i in range(40)], "id long, sex string, age double")
    got = cohort.greedy_match(people.where("id < 8"), people.where("id >= 8"), "id", ["sex"], [("age", 30.0)]).collect()
    assert len(got) == 8 and len({r.match for r in got}) == 8


def test_scalars(spark):
    df = rows(spark, [("74", 70.0, 175.0, {"b": 1, "a": 2}, "f__F|g__G|s__unknown"), ("1/2/1968", None, 1.75, None, "a|b|c"), ("x", 1.0, 0.0, {}, None)], "y string, w double, h double, m map<string,int>, t string")
    got = df.select(scalars.year_of("y"), scalars.body_mass_index("w", "h"), scalars.map_to_string("m"), scalars.taxonomy_name("t")).collect()
    assert [r[0] for r in got] == [1974, 1968, None]
    assert got[0][1] == pytest.approx(22.857, abs=1e-3) and got[1][1] is None and got[2][1] is None
    assert [r[2] for r in got] == ["a:2,b:1", None, ""]
    assert [r[3] for r in got][:2] == ["f__F|s__unknown", "b|c"]


def test_empty_inputs(spark):
    cells = rows(spark, [], "s string, f string, v double")
    assert distance.jaccard(cells, "s", "f").count() == 0
    assert repertoire.diversity(cells, "s", "f", "v").count() == 0
    assert stats.mann_whitney(cells.withColumn("g", F.lit(1)), ["f"], "v", "g").count() == 0
    assert seqsim.padded_hamming_pairs(rows(spark, [], "id long, seq string")).count() == 0


def test_greedy_match_goes_on_while_cases_have_partners(spark):
    people = rows(spark, [(i, "m", 30.0) for i in range(60)], "id long, sex string, age double")  # all ask for the same member first
    got = cohort.greedy_match(people.where("id < 25"), people.where("id >= 25"), "id", ["sex"], [("age", 3.0)]).collect()
    assert {r.id for r in got} == set(range(25)) and len({r.match for r in got}) == 25


def test_permutation_queries_take_the_operators_numbers(spark):
    from cloneloom.plans import catalogue

    assert {r.n_perms for r in catalogue.QUERIES["perm_auc"](spark, "/root/testdata/sf0.001").collect()} <= {100, 1000}
    n_perms = [r.n_perms for r in catalogue.QUERIES["perm_fisher"](spark, "/root/testdata/sf0.001").select("n_perms").collect()]
    assert 0 < max(n_perms) <= 1000 and min(n_perms) > 20


@pytest.mark.parametrize("one_window", [1, 1 << 20])
def test_running_ranks_and_quantiles_of_groups_in_ranges(spark, monkeypatch, one_window):
    monkeypatch.setattr(relational, "ONE_WINDOW", one_window)
    draw = np.random.default_rng(4)
    frame = pd.DataFrame({"g": ["hot"] * 3000 + ["small"] * 7 + ["one"], "v": [*np.round(draw.exponential(size=3000), 2), *range(7), 5.0]})
    df = spark.createDataFrame(frame)
    ranks = relational.ranked(df, "v", ["g"], "rank").toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    frame = frame.sort_values(["g", "v"]).reset_index(drop=True)
    assert (ranks["rank"] == frame.groupby("g").v.rank()).all()
    for down in (False, True):
        got = relational.running(df.withColumn("w", F.lit(1)), ["g"], "v", {"upto": "w"}, down).groupBy("g").agg(F.max("upto").alias("all"), F.count_distinct("upto").alias("n")).collect()
        assert {(r.g, r["all"], r.n) for r in got} == {("hot", 3000, 3000), ("small", 7, 7), ("one", 1, 1)}
    points = [0, 0.013, 0.5, 0.999, 1]
    nulls = df.unionByName(spark.createDataFrame([("small", None), ("none", None)], "g string, v double"))
    for r in relational.quantiles(nulls, "v", points, ["g"]).collect():
        assert r.edges == ([None] * 5 if r.g == "none" else pytest.approx(list(frame[frame.g == r.g].v.quantile(points))))


def test_permuted_aucs_are_those_of_permuted_labels_and_no_row_is_shuffled(spark, monkeypatch):
    draw = np.random.default_rng(4)
    df = rows(spark, [(i * 7, int(draw.random() < 0.3), float(draw.integers(0, 12)) if i % 11 else None) for i in range(150)], "id long, y int, s double").repartition(3)
    want = ml.evaluate_binary(ml.permuted_labels(df.select("id", "y"), "id", "y", 30, 5).join(df.select("id", "s"), "id"), ["perm"], "y", "s")
    want = {r.perm: abs(r.roc_auc - 0.5) for r in want.collect()}
    made = ml.permuted_auc(df, "id", "y", "s", 30, 5)
    assert {r.perm: r.away for r in made.collect()} == want and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    p = (1 + sum(a >= abs(ml.evaluate_binary(df, [], "y", "s").first().roc_auc - 0.5) for a in want.values())) / 31
    with monkeypatch.context() as m:
        m.setattr(ml, "permuted_labels", None)  # a row for each row and permutation
        assert ml.adaptive_auc_p(df, "id", "y", "s", 5, 30, 30, 0.0).first().p == pytest.approx(p)
    monkeypatch.setattr(ml, "MOST_SAMPLES", 10)
    assert {r.perm: r.away for r in ml.permuted_auc(df, "id", "y", "s", 30, 5).collect()} == want
    assert {r.away for r in ml.permuted_auc(df.withColumn("y", F.lit(1)), "id", "y", "s", 3, 5).collect()} == {None}
