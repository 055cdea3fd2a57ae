"""Queries of folds, model selection and permutation tests of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.operators import blocks as B
from cloneloom.operators import relevance, sampling
from cloneloom.operators import selection as M
from cloneloom.operators import stats as S
from cloneloom.plans.proxies import COHORTS, REPERTOIRE, SHARING, cohorts, repertoire, sharing, species, table
from cloneloom.plans.q_associations import BOTH, PAIR_TABLES
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.registry import query

N_PERMS = 1000


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('3:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def fold_stratified(spark, d):
    return M.stratified_folds(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, 3)


@query("""WITH g AS (SELECT c_nationkey, (row_number() OVER (ORDER BY count(*) DESC, md5('3:' || c_nationkey), c_nationkey) - 1) % 8 AS turn FROM customer GROUP BY 1)
SELECT c_custkey, c_nationkey, (CASE WHEN turn < 4 THEN turn ELSE 7 - turn END)::INT AS fold FROM customer JOIN g USING (c_nationkey)""")
def fold_groups(spark, d):
    return M.group_folds(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4, 3)


@query("SELECT doc_id, source, (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1)::INT AS fold FROM documents")
def fold_leave_group_out(spark, d):
    return M.leave_one_group_out(table(spark, d, "documents").select("doc_id", "source"), "source")


FEATURES = ["length", "n_words", "word_length", "n_lines", "digits", "marks", "upper", "is_toxic"]


def text_features(spark, d):
    """Numbers that describe the labelled documents, for models of their quality."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)) / n
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", "text", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.col("quality").alias("y"), "source", F.log1p(n).alias("length"), F.log1p(words).alias("n_words"), (n / F.greatest(words, F.lit(1))).alias("word_length"),
        F.log1p(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0))).alias("n_lines"), share("[0-9]").alias("digits"), share("[#*$%&|<>]").alias("marks"), share(r"\p{Lu}").alias("upper"),
        F.col("toxic").cast("double").alias("is_toxic"),
    )


SPACES = {"logistic": {"regParam": [0.01, 0.1]}, "forest": {"numTrees": [20], "maxDepth": [3, 5]}, "boosted": {"maxIter": [10], "maxDepth": [2, 3]}}


def _selected(spark, d):
    return M.nested_selection(text_features(spark, d), "doc_id", "y", FEATURES, spaces=SPACES, inner=2, n_candidates=None)


@query()
def nested_selection(spark, d):
    """The learner and parameters that each outer fold chose, its score inside and outside."""
    return _selected(spark, d).chosen


@query("""WITH r AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n_rows, count(*) AS n_scored, 0::BIGINT AS n_scored_twice, true AS classes_even, true AS scores_in_range, 3::BIGINT AS n_folds FROM r""")
def nested_selection_invariants(spark, d):
    """Each row is scored once, and class sizes of folds differ by at most 1."""
    scored = _selected(spark, d).predictions
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    per_row = scored.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    sizes = scored.groupBy("y", "fold").agg(F.count("*").alias("n")).groupBy("y").agg((F.max("n") - F.min("n")).alias("gap"))
    told = per_row.agg(F.count("*").alias("n_scored"), F.sum((F.col("n") > 1).cast("long")).alias("n_scored_twice"), F.min((F.col("low") >= 0) & (F.col("high") <= 1)).alias("scores_in_range"))
    even = sizes.agg((F.max("gap") <= 1).alias("classes_even"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(told).crossJoin(even).crossJoin(scored.agg(F.count_distinct("fold").alias("n_folds")))  # one row each


@query()
def all_relevant(spark, d):
    """Which numbers of a document say something of its quality, against shuffled copies."""
    return relevance.all_relevant(text_features(spark, d), "doc_id", "y", FEATURES)


#: Which sample's second row each sample gets in a permutation.
DEALT = """s AS (SELECT sample, row_number() OVER (ORDER BY sample) AS i FROM {samples}),
pr AS (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', {seed}, perm, sample))) AS i FROM s, (SELECT unnest(range(1, 1001)) AS perm)),
dealt AS (SELECT perm, s.sample, pr.sample AS other FROM pr JOIN s USING (i))"""


@query(f"""WITH {PAIR_TABLES}, {DEALT.format(samples="both_", seed=1)},
m AS (SELECT perm, sequence, feature, count(*) AS a2 FROM x JOIN dealt USING (sample) JOIN y ON y.sample = dealt.other GROUP BY ALL),
c AS (SELECT sequence, feature, a2, count(*) AS times FROM m GROUP BY ALL),
z AS (SELECT * FROM c UNION ALL SELECT sequence, feature, 0, 1000 - sum(times) FROM c GROUP BY ALL UNION ALL SELECT sequence, feature, 0, 1000 FROM tab ANTI JOIN c USING (sequence, feature)),
w AS (SELECT tab.*, a2, times, CASE WHEN a * d = 0 OR b * c = 0 THEN 1e300 ELSE abs(ln(a::DOUBLE * d / (b * c))) END AS own,
  CASE WHEN a2 * (d - a + a2) = 0 OR (b + a - a2) * (c + a - a2) = 0 THEN 1e300 ELSE abs(ln(a2::DOUBLE * (d - a + a2) / ((b + a - a2) * (c + a - a2)))) END AS other FROM tab JOIN z USING (sequence, feature))
SELECT sequence, feature, a + b + c + d AS n, a, b, c, d, CASE WHEN a * d > 0 OR b * c > 0 THEN round((1 + sum(CASE WHEN other >= own - 1e-9 THEN times ELSE 0 END)) / 1001.0, 6) END AS p, 1000::BIGINT AS n_perms FROM w GROUP BY sequence, feature, a, b, c, d""")
def perm_seq_species(spark, d):
    return rounded(B.pair_permutation_test(sharing(spark, d), species(spark, d), "sample", "sequence", "feature", "odds", n_perms=N_PERMS), "p")


@query(f"""WITH {BOTH}, {DEALT.format(samples="both_", seed=1)},
sx AS (SELECT sequence, sum(frequency) AS s1, sum(frequency ** 2) AS q1 FROM x GROUP BY 1), sy AS (SELECT feature, sum(abundance) AS s2, sum(abundance ** 2) AS q2 FROM y GROUP BY 1),
real_ AS (SELECT sequence, feature, sum(frequency * abundance) AS xy FROM x JOIN y USING (sample) GROUP BY ALL),
m AS (SELECT perm, sequence, feature, sum(frequency * abundance) AS xy2 FROM x JOIN dealt USING (sample) JOIN y ON y.sample = dealt.other GROUP BY ALL),
pairs AS (SELECT sequence, feature, coalesce(xy, 0) AS xy, s1, s2, n, sqrt((q1 - s1 ** 2 / n) * (q2 - s2 ** 2 / n)) AS spread FROM sx CROSS JOIN sy CROSS JOIN n LEFT JOIN real_ USING (sequence, feature)),
r AS (SELECT sequence, feature, n, (xy - s1 * s2 / n) / spread AS r, abs(s1 * s2 / n / spread) AS none, s1, s2, spread FROM pairs WHERE spread > 1e-9),
k AS (SELECT sequence, feature, count(*) AS met, count(*) FILTER (abs((xy2 - s1 * s2 / n) / spread) >= abs(r) - 1e-9) AS above FROM m JOIN r USING (sequence, feature) GROUP BY ALL)
SELECT sequence, feature, n, round(r, 5) + 0.0 AS r, round((1 + coalesce(above, 0) + CASE WHEN none >= abs(r) - 1e-9 THEN 1000 - coalesce(met, 0) ELSE 0 END) / 1001.0, 6) AS p, 1000::BIGINT AS n_perms FROM r LEFT JOIN k USING (sequence, feature)""")
def perm_seq_species_corr(spark, d):
    found = B.pair_permutation_test(sharing(spark, d), species(spark, d), "sample", "sequence", "feature", "pearson", "frequency", "abundance", n_perms=N_PERMS)
    return rounded(found.where("r is not null").withColumn("r", F.round("r", 5) + 0.0), "p")  # no negative zeros


@query(f"""WITH {SHARING}, {COHORTS}, {DEALT.format(samples="cohorts", seed=4)}, e AS (SELECT sum(cohort)::BIGINT AS N1, count(*) AS N FROM cohorts),
f AS (SELECT DISTINCT sample, sequence AS feature FROM share JOIN cohorts USING (sample)),
real_ AS (SELECT feature, sum(cohort)::BIGINT AS a, count(*) AS k FROM f JOIN cohorts USING (sample) GROUP BY 1),
m AS (SELECT perm, feature, sum(cohort)::BIGINT AS a FROM f JOIN dealt USING (sample) JOIN cohorts c ON c.sample = dealt.other GROUP BY ALL),
t AS (SELECT DISTINCT a, k FROM (SELECT a, k FROM real_ UNION ALL SELECT m.a, k FROM m JOIN real_ USING (feature))),
h AS (SELECT a, k, j, exp(lgamma(k + 1) + lgamma(N - k + 1) + lgamma(N1 + 1) + lgamma(N - N1 + 1) - lgamma(N + 1) - lgamma(j + 1) - lgamma(k - j + 1) - lgamma(N1 - j + 1) - lgamma(N - k - N1 + j + 1)) AS q
  FROM (SELECT t.*, e.*, unnest(range(greatest(0, k + N1 - N), least(k, N1) + 1)) AS j FROM t, e)),
o AS (SELECT *, max(q) FILTER (j = a) OVER (PARTITION BY a, k) AS own FROM h), p AS (SELECT a, k, least(1, sum(q) FILTER (q <= own * (1 + 1e-7))) AS p FROM o GROUP BY a, k),
v AS (SELECT r.feature, rp.p AS own, mp.p AS other FROM real_ r JOIN p rp ON rp.a = r.a AND rp.k = r.k JOIN m ON m.feature = r.feature JOIN p mp ON mp.a = m.a AND mp.k = r.k)
SELECT feature, round(-log10(own), 6) + 0.0 AS score, round((1 + count(*) FILTER (other <= own * (1 + 1e-7))) / 1001.0, 6) AS p, count(*) AS n_perms FROM v GROUP BY feature, own""")
def perm_fisher(spark, d):
    """Fisher p of each feature in two cohorts against that of label permutations."""
    cells, groups = sharing(spark, d).withColumnRenamed("sequence", "feature"), cohorts(spark, d)
    found = B.pair_permutation_test(cells, groups.where("cohort = 1").withColumn("label", F.lit(1)), "sample", "feature", "label", "fisher", samples=groups, n_perms=N_PERMS, seed=4)
    own = S.fisher_exact(found.select("a", "b", "c", "d").distinct(), "a", "b", "c", "d", "own").drop("odds_ratio")
    return found.join(own, ["a", "b", "c", "d"]).select("feature", (F.round(-F.log10("own"), 6) + 0.0).alias("score"), F.round("p", 6).alias("p"), "n_perms")


@query(f"""WITH {REPERTOIRE}, s AS (SELECT sample, sum(templates)::BIGINT AS total FROM rep GROUP BY 1)
SELECT sample, total, 500::BIGINT AS drawn, true AS within_counts FROM s WHERE total >= 500""")
def subsample_invariants(spark, d):
    """Exact subsampling: each sample that has them gives 500 templates, no clone more than it has."""
    rows = repertoire(spark, d).select("sample", "nucleotide", "templates")
    have = rows.groupBy("sample", "nucleotide").agg(F.sum("templates").alias("n"))
    got = sampling.subsample(rows, "sample", ["nucleotide"], "templates", 500, 7)
    return have.join(got, ["sample", "nucleotide"], "left").groupBy("sample").agg(F.sum("n").alias("total"), F.sum("drawn").alias("drawn"), F.min(F.coalesce("drawn", F.lit(0)) <= F.col("n")).alias("within_counts")).where("total >= 500")
