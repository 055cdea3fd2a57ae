"""Steps that grew faster than their input, or took rows in the order in which they came."""

import pytest
from pyspark.sql import functions as F

from cloneloom.operators import associations, blocks, cleaning, cohort, distance, ml, relational, repertoire, selection, seqsim


def test_share_that_is_just_the_limit_is_not_over_it(spark):
    rows = [(1, "a", 0.1), (1, "a", 0.2), (1, "b", 1.2), (2, "a", 1.0), (2, "b", float("inf")), (3, "a", 0.0), (4, "a", None), (4, "b", 2.0), (5, "a", 1e-12), (5, "b", 1e-12)]
    assert (0.1 + 0.2) / (0.1 + 0.2 + 1.2) > 0.2  # what doubles say
    got = {(r.g, r.k): r.over for r in relational.share_above(spark.createDataFrame(rows, "g int, k string, v double"), "g", ["k"], "v", 0.2, "over").collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 0, (2, "b"): 1, (3, "a"): None, (4, "a"): None, (4, "b"): 1, (5, "a"): 1, (5, "b"): 1}


def test_places_by_columns_up_and_down(spark, monkeypatch):
    monkeypatch.setattr(relational, "BUCKETS", 5)
    df = spark.range(300).select("id", (F.col("id") % 7).cast("string").alias("a"), (F.col("id") * 31 % 50).alias("b"))
    got = relational.places_by(df, [F.desc("a"), "b", "id"], "place")
    rows = sorted(got.collect(), key=lambda r: (-int(r.a), r.b, r.id))
    assert [r.place for r in rows] == list(range(1, 301))


def test_scores_of_pairs_that_carry_their_groups_take_no_join(spark):
    people = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, None, 1), (4, 6, None)], "person int, nation int, region int")
    carried = cohort.relation_scores(distance.all_pairs(people, "person", ["nation", "region"]), None, "person", ["nation", "region"])
    joined = cohort.relation_scores(distance.all_pairs(people, "person", []), people, "person", ["nation", "region"])
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect()))
    assert {(r.sample1, r.sample2): r.total for r in carried.collect()}[(1, 2)] == 2
    assert "Exchange" not in carried._jdf.queryExecution().executedPlan().toString()


def test_subset_pairs_of_equal_sets_are_not_counted_pair_by_pair(spark, monkeypatch):
    import random

    draw = random.Random(3)
    rows = [(g, i) for g in range(60) for i in draw.sample("abcde", draw.choice([1, 2, 5, 5]))] + [(60, None), (60, "a"), (61, None), (None, "a")]
    rows += rows[:9]
    members = {}
    for g, i in rows:
        members.setdefault(g, set()).add(i)
    want = sorted((a, b) for a in members for b in members if None not in (a, b) and a != b and None not in members[a] and members[a] <= members[b])
    found = cleaning.subset_pairs(spark.createDataFrame(rows, "g int, i string"), "g", "i", chunk=7)
    assert sorted((r.inner, r.outer) for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # lists of groups are taken apart last
    monkeypatch.setattr(cleaning.F, "xxhash64", lambda *c: cleaning.F.lit(0).cast("long"))  # all hashes collide
    assert sorted((r.inner, r.outer) for r in cleaning.subset_pairs(spark.createDataFrame(rows, "g int, i string"), "g", "i", chunk=7).collect()) == want


@pytest.mark.parametrize("slack", [8, -1e9])
def test_downsample_sends_only_low_hashes_and_takes_short_samples_anew(spark, monkeypatch, slack):
    import hashlib
    from collections import Counter

    monkeypatch.setattr(repertoire, "SLACK", slack)
    rows = [(s, i, 400 * (i % 3) + 1) for s in ("s", None) for i in range(20)] + [("t", 1, 3), ("u", 1, 50), ("s", 99, 0), ("s", 98, None)]
    want = {}
    for s in ("s", None, "u"):
        copies = sorted((hashlib.md5(":".join(str(x) for x in (5, s, i, c) if x is not None).encode()).hexdigest(), i, c) for t, i, n in rows if t == s for c in range(1, (n or 0) + 1))
        want.update({(s, i): k for i, k in Counter(i for _, i, _ in copies[:50]).items()})
    got = repertoire.downsample(spark.createDataFrame(rows, "sample string, clone int, n int"), "sample", ["clone"], "n", 50, 5)
    assert {(r["sample"], r.clone): r.drawn for r in got.collect()} == want


def test_permutation_tests_keep_a_task_small_whatever_the_samples(spark, monkeypatch):
    import hashlib

    names = [str(i) for i in range(50)]
    want = [sorted(range(50), key=lambda i: hashlib.md5(f"7:{k}:{names[i]}".encode()).hexdigest()) for k in (3, 4)]
    assert blocks.permutations(names, 2, 7, 3).tolist() == want
    assert blocks._dealt(spark, spark.sparkContext.broadcast(names), 2, 7, 3).tolist() == want
    x = spark.range(40).select((F.col("id") % 20).alias("s"), (F.col("id") * 7 % 9).alias("f"), (F.col("id") % 5 + 1.0).alias("v"))
    y = spark.range(30).select((F.col("id") % 20).alias("s"), (F.col("id") * 5 % 4).alias("g"), (F.col("id") % 3 + 1.0).alias("w"))
    x, y = x.dropDuplicates(["s", "f"]), y.dropDuplicates(["s", "g"])
    of = lambda: sorted((r.f, r.g, round(r.r, 9), r.p, r.n_perms) for r in blocks.pair_permutation_test(x, y, "s", "f", "g", "pearson", "v", "w", n_perms=20).collect())
    whole = of()
    monkeypatch.setattr(blocks, "TASK_BYTES", 2 * 20 * 8)
    assert of() == whole


def test_permuted_labels_shuffle_the_permutations_once(spark):
    import hashlib

    rows = [(k, k * 3 % 7) for k in range(40)]
    got = ml.permuted_labels(spark.createDataFrame(rows, "k int, y int"), "k", "y", 3, 5)
    want = {(p, k): y for p in (1, 2, 3) for (k, _), (_, y) in zip(rows, sorted(rows, key=lambda r: hashlib.md5(f"5:{p}:{r[0]}".encode()).hexdigest()))}
    assert {(r.perm, r.k): r.y for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # one for the ranges' counts, one for the labels


def test_dense_distances_send_no_vectors_and_keep_odd_ones(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[0.1, 0.2, 0.0], [0.3, -0.2, 0.0], [0.1, 0.2, 0.0], None, [0.1, None, 2.0], [0.5, 0.25], [], [], [nan, 0.0, 1.0], [nan, 1.0, inf], [-inf, 0.0, 1e12]]
    data = [(i, v) for i, v in enumerate(vectors)] + [(None, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "k int, v array<float>")
    fold = lambda term: F.aggregate(F.zip_with("v1", "v2", term), F.lit(0.0), lambda s, x: s + x)
    square = fold(lambda x, y: (x - y) * (x - y))
    plain = distance.all_pairs(rows.select("k", F.col("v").cast("array<double>")), "k", ["v"]).select(
        "sample1", "sample2", F.sqrt(square), square, fold(lambda x, y: F.abs(x - y)), fold(lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))),
        F.try_divide(fold(lambda x, y: (x != y).cast("double")), F.size("v1").cast("double")),
    )
    for chunk in (2, 2048):
        got = distance.dense_distances(rows, "k", "v", chunk)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
        assert got._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # no expression over arrays of each pair
    halves = distance.dense_distances(spark.createDataFrame([(1, [0.0] * 128), (2, [1.0] + [0.0] * 127)], "k int, v array<double>"), "k", "v", digits=6).first()
    assert halves.hamming == 0.007813


def test_permanova_of_cells_takes_no_pair_out_of_its_block(spark, monkeypatch):
    rows = [(s, f) for s in range(40) for f in range(12) if (s * 7 + f * f + s // 3 * f) % 5 < 2 or f == s % 2]
    groups = spark.createDataFrame([(s, None if s == 5 else "abc"[s % 3]) for s in range(41) if s != 7], "s int, g string")  # one without a group, one not told, one without cells
    cells = spark.createDataFrame(rows + rows[:9], "s int, f int")
    want = associations.permanova_p(distance.jaccard(cells, "s", "f"), groups, "s", "g", 30).first()
    assert 0 < want.p < 1 and want.n_perms == 30
    several = associations.permanova_jaccard(cells, groups, "s", "f", "g", 30, size=4).first()
    monkeypatch.setattr(associations, "permanova_p", None)
    got = associations.permanova_jaccard(cells, groups, "s", "f", "g", 30).first()
    for r in (several, got):
        assert (r.n, r.groups, r.n_perms) == (want.n, want.groups, 30) and r.f == pytest.approx(want.f, rel=1e-12) and r.p == want.p


def test_named_aggregates_do_not_multiply_rows_to_count_different_values(spark):
    rows = [(g, v, w, p) for g in (1, 2, None) for v in ("a", "b", "b", None) for w in (1.0, 2.0) for p in (True, v == "a", None)] + [(4, None, None, None)]
    df = spark.createDataFrame(rows, "g int, v string, w double, productive boolean")
    wanted = {"mean": ["w"], "n_distinct": ["v", "w"], "max": ["v"]}
    for by in (["g"], []):
        got = cleaning.named_aggregates(df, by, wanted)
        parts = {"total": F.lit(True), "prod": F.col("productive"), "nonprod": ~F.col("productive")}
        of = {"mean": F.avg, "n_distinct": F.count_distinct, "max": F.max}
        want = df.groupBy(*by).agg(*[of[f](F.when(t, F.col(c))).alias(f"{f}_{c}_{p}") for f, cs in wanted.items() for c in cs for p, t in parts.items()])
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_nested_selection_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(90).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2 + F.col("id") % 5).cast("double").alias("x")).mapInArrow(seen, "id long, y long, x double")
    got = selection.nested_selection(rows, "id", "y", ["x"], spaces={"logistic": {"regParam": [0.1]}}, outer=2, inner=2, n_candidates=None)
    assert got.predictions.count() == 90 and made.value == 90


@pytest.mark.parametrize("k", [1, 3, 8, 11])
def test_exact_matches_make_rows_of_likely_offsets_only(spark, monkeypatch, k):
    monkeypatch.setattr(seqsim, "SIEVE_BYTES", 13)
    texts = ["", None, "abcabcabcabcabc", "xé€𝄞abcabcabcabcé€𝄞é€𝄞é€𝄞é€𝄞é€𝄞", "ab", "ééé", "a\0b\0\0\0\0\0\0\0\0\0\0", "abcabcabcabc" * 9]
    asked = ["abc", "a", "cabcabcabca", "abcabcabcabc", "é€𝄞é€𝄞é€𝄞é€", "\0\0\0", "€", "abcabcabcabc" * 8, "\0" * 11]
    want = sorted((i, p, o) for i, t in enumerate(texts) for p in asked if len(p) >= k for o in range(len(t or "")) if t.startswith(p, o))
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    patterns = spark.createDataFrame([(p,) for p in asked], "p string")
    assert sorted(map(tuple, seqsim.exact_matches(frame, "id", "t", patterns, "p", k).collect())) == want
    plain = spark.createDataFrame([(1, "z" * 5000)], "id int, t string")
    assert seqsim._sieved(plain, "id", "t", patterns.select(F.col("p").alias("kmer")), k, 12).count() == 0


def test_pairs_in_order_are_numbered_where_they_are_made(spark, monkeypatch):
    from cloneloom import products
    from cloneloom.plans import catalogue

    monkeypatch.setattr(products, "PARTS", 3)
    rows = [(f"s{s}", f) for s in range(75) for f in range(30) if (s * 7 + f * f + s // 3 * f) % 5 < 2 and s % 10] + [("s9", None), ("s8", None), (None, 1), ("é", 1), ("alone", 99), ("B", 2), ("B", 2)]
    have = {}
    for s, f in rows:
        have.setdefault(s, set()).add(f)
    names = sorted((s for s in have if s is not None), key=str.encode)
    pairs = sorted((len((have[a] & have[b]) - {None}), a.encode(), b.encode(), a, b) for k, a in enumerate(names) for b in names[k + 1 :])
    want = [(a, b, float(n), place) for place, (n, _, _, a, b) in enumerate((p for p in pairs if p[0]), 1)]
    cells = spark.createDataFrame(rows, "s string, f int")
    for chunk, size in ((4, None), (None, None), (7, 8)):
        got = distance.ordered_shared(cells, "s", "f", chunk, size)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    assert distance.ordered_shared(cells.where("s = 'alone'"), "s", "f").count() == 0
    plan = catalogue.QUERIES["pairs_ordered"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[1].strip().startswith("+- MapInArrow")  # no window, sort or join above the pairs
