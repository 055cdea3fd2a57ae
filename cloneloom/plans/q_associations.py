"""Queries of associations between all features, permutation tests and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.operators import associations as A
from cloneloom.plans.proxies import COHORTS, SHARING, SPECIES, cohorts, sharing, species, table
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.q_statistics import CUSTOMER, _customers
from cloneloom.plans.registry import query

#: Sequences and species on the samples that both tables have, and their presence tables.
BOTH = SHARING + ", " + SPECIES + """, both_ AS (SELECT DISTINCT sample FROM share INTERSECT SELECT DISTINCT sample FROM species),
x AS (SELECT share.* FROM share JOIN both_ USING (sample)), y AS (SELECT species.* FROM species JOIN both_ USING (sample)), n AS (SELECT count(*) AS n FROM both_)"""
PAIR_TABLES = BOTH + """, met AS (SELECT sequence, feature, count(*) AS a FROM x JOIN y USING (sample) GROUP BY ALL),
tab AS (SELECT sequence, feature, coalesce(a, 0) AS a, k1 - coalesce(a, 0) AS b, k2 - coalesce(a, 0) AS c, n - k1 - k2 + coalesce(a, 0) AS d
 FROM (SELECT sequence, count(*) AS k1 FROM x GROUP BY 1) CROSS JOIN (SELECT feature, count(*) AS k2 FROM y GROUP BY 1) CROSS JOIN n LEFT JOIN met USING (sequence, feature))"""


@query(f"WITH {PAIR_TABLES} SELECT * FROM tab")
def seq_species_tables(spark, d):
    return A.pair_tables(sharing(spark, d), species(spark, d), "sample", "sequence", "feature")


@query(f"""WITH {PAIR_TABLES}, k AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM (SELECT DISTINCT a, b, c, d FROM tab)),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS p FROM k),
o AS (SELECT *, max(p) FILTER (k = a) OVER (PARTITION BY a, b, c, d) AS own FROM p), t AS (SELECT a, b, c, d, least(1, sum(p) FILTER (p <= own * (1 + 1e-7))) AS p FROM o GROUP BY ALL)
SELECT sequence, feature, a, b, c, d, round(p, 6) AS p, round(CASE WHEN b * c > 0 THEN a * d / (b * c) ELSE 999999 END, 6) AS odds_ratio FROM tab JOIN t USING (a, b, c, d)""")
def seq_species_fisher(spark, d):
    return rounded(A.pair_fisher(sharing(spark, d), species(spark, d), "sample", "sequence", "feature"), "p", "odds_ratio")


DENSE_PAIRS = BOTH + """, pairs AS (SELECT sequence, feature, count(*) AS n_both FROM x JOIN y USING (sample) GROUP BY ALL HAVING count(*) >= 0.1 * (SELECT n FROM n)),
full_ AS (SELECT p.sequence, p.feature, n_both, coalesce(x.frequency, 0) AS v1, coalesce(y.abundance, 0) AS v2 FROM pairs p CROSS JOIN both_ b LEFT JOIN x ON x.sample = b.sample AND x.sequence = p.sequence LEFT JOIN y ON y.sample = b.sample AND y.feature = p.feature)"""


@query(f"WITH {DENSE_PAIRS} SELECT sequence, feature, count(*) AS n, any_value(n_both) AS n_both, round(corr(v1, v2), 6) + 0.0 AS r FROM full_ GROUP BY 1, 2")
def seq_species_corr(spark, d):
    out = A.pair_correlations(sharing(spark, d), species(spark, d), "sample", "sequence", "frequency", "feature", "abundance")
    return out.select("sequence", "feature", "n", "n_both", (F.round("r", 6) + 0.0).alias("r"))  # no negative zeros


@query(f"""WITH {DENSE_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY sequence, feature ORDER BY v1) + (count(*) OVER (PARTITION BY sequence, feature, v1) - 1) / 2.0 AS r1,
 rank() OVER (PARTITION BY sequence, feature ORDER BY v2) + (count(*) OVER (PARTITION BY sequence, feature, v2) - 1) / 2.0 AS r2 FROM full_)
SELECT sequence, feature, count(*) AS n, any_value(n_both) AS n_both, round(corr(r1, r2), 6) + 0.0 AS r FROM r GROUP BY 1, 2""")
def seq_species_spearman(spark, d):
    out = A.pair_correlations(sharing(spark, d), species(spark, d), "sample", "sequence", "frequency", "feature", "abundance", "spearman")
    return out.select("sequence", "feature", "n", "n_both", (F.round("r", 6) + 0.0).alias("r"))


def _long(spark, d):
    rows = _customers(spark, d).withColumn("spent", F.col("spent") * 1.0)
    features = rows.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("spent"), F.col("n_orders").cast("double").alias("orders")).unpivot("c_custkey", ["balance", "spent", "orders"], "feature", "value")
    phenotypes = rows.select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), F.col("grp").cast("double").alias("third"), (F.col("c_custkey") % 2).cast("double").alias("odd"))
    return features, phenotypes.unpivot("c_custkey", ["nation", "third", "odd"], "phenotype", "level")


LONG = CUSTOMER + """, f AS (SELECT c_custkey, feature, value FROM (SELECT c_custkey, c_acctbal AS balance, spent::DOUBLE AS spent, n_orders::DOUBLE AS orders FROM c) UNPIVOT (value FOR feature IN (balance, spent, orders))),
ph AS (SELECT c_custkey, phenotype, level FROM (SELECT c_custkey, c_nationkey::DOUBLE AS nation, grp::DOUBLE AS third, (c_custkey % 2)::DOUBLE AS odd FROM c) UNPIVOT (level FOR phenotype IN (nation, third, odd)))"""


@query(f"WITH {LONG} SELECT feature, phenotype, count(*) AS n, round(corr(value, level), 6) AS r FROM f JOIN ph USING (c_custkey) GROUP BY 1, 2")
def assoc_all_features(spark, d):
    return rounded(A.phenotype_correlations(*_long(spark, d), "c_custkey").select("feature", "phenotype", "n", "r"), "r")


@query(f"""WITH {LONG}, j AS (SELECT * FROM f JOIN ph USING (c_custkey) WHERE level IN (0, 1)), r AS (SELECT *, rank() OVER (PARTITION BY feature, phenotype ORDER BY value) + (count(*) OVER (PARTITION BY feature, phenotype, value) - 1) / 2.0 AS k FROM j),
a AS (SELECT feature, phenotype, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 0) AS n0, avg(value) FILTER (level = 1) AS m1, avg(value) FILTER (level = 0) AS m0, var_samp(value) FILTER (level = 1) AS v1, var_samp(value) FILTER (level = 0) AS v0, sum(k) FILTER (level = 1) AS s FROM r GROUP BY ALL)
SELECT feature, phenotype, n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 6) AS t, (s - n1 * (n1 + 1) / 2)::DOUBLE AS u1 FROM a""")
def assoc_group_tests(spark, d):
    out = A.phenotype_group_tests(*_long(spark, d), "c_custkey")
    return rounded(out.select("feature", "phenotype", "n1", "n0", "t", "u1"), "t")


COLUMNS = ["c_acctbal", "spent", "n_orders", "c_nationkey"]


@query(f"WITH {CUSTOMER} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM c" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]))
def correlation_matrix(spark, d):
    return rounded(A.correlation_matrix(_customers(spark, d), COLUMNS).drop("p"), "r")


@query(f"""WITH {CUSTOMER}, a AS (SELECT perm, c_custkey, c_acctbal, spent, n_orders, row_number() OVER (PARTITION BY perm ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', '1', perm, c_custkey)), c_custkey) AS j FROM c, (SELECT unnest(range(1, 101)) AS perm)),
p AS (SELECT a.perm, corr(a.c_acctbal, b.spent) AS r0, corr(a.c_acctbal, b.n_orders) AS r1, corr(a.spent, b.n_orders) AS r2 FROM a JOIN a b ON a.perm = b.perm AND a.i = b.j GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round((SELECT corr({a}, {b}) FROM c), 6) AS r, round(quantile_cont(r{i}, 0.025), 6) AS low, round(quantile_cont(r{i}, 0.975), 6) AS high, (SELECT corr({a}, {b}) FROM c) < quantile_cont(r{i}, 0.025) OR (SELECT corr({a}, {b}) FROM c) > quantile_cont(r{i}, 0.975) AS outside FROM p" for i, (a, b) in enumerate((("c_acctbal", "spent"), ("c_acctbal", "n_orders"), ("spent", "n_orders")))))
def correlation_intervals(spark, d):
    return rounded(A.correlation_intervals(_customers(spark, d), "c_custkey", ["c_acctbal", "spent", "n_orders"]), "r", "low", "high")


JACCARD = SHARING + """, sn AS (SELECT sample, count(*) AS n FROM share GROUP BY 1), sb AS (SELECT a.sample AS s1, c.sample AS s2, count(*) AS k FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL),
jac AS (SELECT x.sample AS s1, y.sample AS s2, 1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) AS dist FROM sn x JOIN sn y ON x.sample < y.sample LEFT JOIN sb ON sb.s1 = x.sample AND sb.s2 = y.sample)"""


@query(f"""WITH {JACCARD}, {COHORTS}, g AS (SELECT sample, cohort FROM cohorts WHERE sample IN (SELECT sample FROM share)), z AS (SELECT cohort, count(*) AS k FROM g GROUP BY 1), w AS (SELECT sum(k) AS n, count(*) AS groups FROM z), tot AS (SELECT sum(dist ** 2) AS total FROM jac),
pl AS (SELECT perm, sample, cohort, row_number() OVER (PARTITION BY perm ORDER BY sample) AS i, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', '1', perm, sample)), sample) AS j FROM g, (SELECT unnest(range(1, 101)) AS perm)),
l AS (SELECT a.perm, a.sample, b.cohort FROM pl a JOIN pl b ON a.perm = b.perm AND a.i = b.j UNION ALL SELECT 0, sample, cohort FROM g),
s AS (SELECT x.perm, sum(dist ** 2 / k) AS within FROM jac JOIN l x ON x.sample = s1 JOIN l y ON y.sample = s2 AND y.perm = x.perm AND y.cohort = x.cohort JOIN z ON z.cohort = x.cohort GROUP BY 1),
f AS (SELECT perm, (total / n - within) / (groups - 1) / (within / (n - groups)) AS f FROM s, w, tot)
SELECT (SELECT n FROM w)::BIGINT AS n, (SELECT groups FROM w) AS groups, round((SELECT f FROM f WHERE perm = 0), 6) AS f, round((1 + count(*) FILTER (f >= (SELECT f FROM f WHERE perm = 0) - 1e-12)) / (1 + count(*)), 6) AS p, count(*) AS n_perms FROM f WHERE perm > 0""")
def permanova_p(spark, d):
    cells = sharing(spark, d)
    groups = cohorts(spark, d).join(cells.select("sample").distinct(), "sample", "left_semi")
    return rounded(A.permanova_jaccard(cells, groups, "sample", "sequence", "cohort"), "f", "p")


@query(f"""WITH {JACCARD}, st AS (SELECT sample, sum(frequency) AS t FROM share GROUP BY 1), sl AS (SELECT a.sample AS s1, c.sample AS s2, sum(least(a.frequency, c.frequency)) AS low FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL),
bc AS (SELECT x.sample AS s1, y.sample AS s2, 1 - 2 * coalesce(low, 0) / (x.t + y.t) AS dist FROM st x JOIN st y ON x.sample < y.sample LEFT JOIN sl ON sl.s1 = x.sample AND sl.s2 = y.sample),
pl AS (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY sample) AS i, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', '1', perm, sample)), sample) AS j FROM sn, (SELECT unnest(range(1, 101)) AS perm)),
l AS (SELECT a.perm, a.sample, b.sample AS other FROM pl a JOIN pl b ON a.perm = b.perm AND a.i = b.j),
m AS (SELECT x.perm, corr(jac.dist, bc.dist) AS r FROM jac JOIN l x ON x.sample = jac.s1 JOIN l y ON y.sample = jac.s2 AND y.perm = x.perm JOIN bc ON bc.s1 = least(x.other, y.other) AND bc.s2 = greatest(x.other, y.other) GROUP BY 1), o AS (SELECT count(*) AS n, corr(jac.dist, bc.dist) AS r FROM jac JOIN bc USING (s1, s2))
SELECT o.n, round(o.r, 6) AS r, round((1 + count(*) FILTER (abs(m.r) >= abs(o.r) - 1e-12)) / (1 + count(*)), 6) AS p, count(*) AS n_perms FROM m, o GROUP BY o.n, o.r""")
def mantel_p(spark, d):
    return rounded(A.mantel_distances(sharing(spark, d), "sample", "sequence", "frequency"), "r", "p")


@query(f"""WITH {CUSTOMER}, g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM c GROUP BY 1), t AS (SELECT avg(c_acctbal) AS gm FROM c)
SELECT 'anova' AS test, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS statistic FROM g, t""")
def compare_many(spark, d):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return rounded(A.compare_samples(_customers(spark, d), "c_acctbal", "c_mktsegment", levels).drop("p"), "statistic", digits=5)


@query(f"""WITH {CUSTOMER}, a AS (SELECT count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 0) AS n0, avg(spent) FILTER (grp = 1) AS m1, avg(spent) FILTER (grp = 0) AS m0, var_samp(spent) FILTER (grp = 1) AS v1, var_samp(spent) FILTER (grp = 0) AS v0 FROM c),
s AS (SELECT spent, sum(sum(grp)) OVER (ORDER BY spent) / (SELECT n1 FROM a) AS x, sum(sum(1 - grp)) OVER (ORDER BY spent) / (SELECT n0 FROM a) AS y FROM c GROUP BY spent)
SELECT 'ks' AS test, round(max(abs(x - y)), 5) AS statistic FROM s UNION ALL SELECT 't', round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 5) FROM a""")
def compare_two(spark, d):
    return rounded(A.compare_samples(_customers(spark, d), "spent", "grp", [1, 0]).drop("p"), "statistic", digits=5)


@query(f"""WITH {CUSTOMER}, l AS (SELECT grp, "column", value FROM (SELECT grp, c_acctbal AS balance, n_orders::DOUBLE AS orders, (c_custkey % 2)::DOUBLE AS odd FROM c) UNPIVOT (value FOR "column" IN (balance, orders, odd))),
a AS (SELECT "column", count(DISTINCT value) AS k, count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 0) AS n0, avg(value) FILTER (grp = 1) AS m1, avg(value) FILTER (grp = 0) AS m0, stddev_samp(value) FILTER (grp = 1) AS s1, stddev_samp(value) FILTER (grp = 0) AS s0 FROM l GROUP BY 1),
o AS (SELECT "column", value, grp, count(*) AS o FROM l GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY "column", value) * sum(o) OVER (PARTITION BY "column", grp) / sum(o) OVER (PARTITION BY "column") AS e FROM o), q AS (SELECT "column", sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) AS chi2 FROM e GROUP BY 1)
SELECT "column", n1, round(m1, 5) AS mean1, round(s1, 5) AS std1, n0, round(m0, 5) AS mean0, round(s0, 5) AS std0, CASE WHEN k <= 2 THEN 'chi2' ELSE 't' END AS test,
 round(CASE WHEN k <= 2 THEN chi2 ELSE (m1 - m0) / sqrt(((n1 - 1) * s1 ** 2 + (n0 - 1) * s0 ** 2) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) END, 5) AS statistic FROM a JOIN q USING ("column")""")
def compare_datasets(spark, d):
    rows = _customers(spark, d).select("grp", F.col("c_acctbal").alias("balance"), F.col("n_orders").alias("orders"), (F.col("c_custkey") % 2).alias("odd"))
    return rounded(A.compare_datasets(rows, "grp", ["balance", "orders", "odd"]).drop("p"), "mean1", "std1", "mean0", "std0", "statistic", digits=5)


@query(f"""WITH {SHARING}, {COHORTS}, p AS (SELECT a.sample AS s1, c.sample AS s2, count(*)::DOUBLE AS v FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL), g AS (SELECT x.cohort + y.cohort AS k, v FROM p JOIN cohorts x ON x.sample = s1 JOIN cohorts y ON y.sample = s2),
a AS (SELECT count(*) FILTER (k = 2) AS n1, count(*) FILTER (k = 0) AS n2, avg(v) FILTER (k = 0) AS ma, avg(v) FILTER (k = 2) AS mb, var_samp(v) FILTER (k = 0) AS va, var_samp(v) FILTER (k = 2) AS vb FROM g),
s AS (SELECT v, sum(count(*) FILTER (k = 2)) OVER (ORDER BY v) / (SELECT n1 FROM a) AS x, sum(count(*) FILTER (k = 0)) OVER (ORDER BY v) / (SELECT n2 FROM a) AS y FROM g WHERE k <> 1 GROUP BY v)
SELECT n1, n2, round(ma, 5) AS mean_a, round(mb, 5) AS mean_b, round((SELECT max(abs(x - y)) FROM s), 5) AS d, round((mb - ma) / sqrt(((n1 - 1) * vb + (n2 - 1) * va) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 5) AS t, round(abs(ma - mb) / (ma + mb), 5) AS normalised_difference FROM a""")
def pair_class_tests(spark, d):
    counts = A.shared_class_counts(sharing(spark, d), cohorts(spark, d), "sample", "sequence", "cohort")
    return rounded(A.pair_class_tests(counts, "n_shared", weight="n").drop("p_ks", "p_t"), "mean_a", "mean_b", "d", "t", "normalised_difference", digits=5)


@query(f"WITH {CUSTOMER} SELECT c_mktsegment, regr_count(spent, n_orders)::BIGINT AS n, round(regr_slope(spent, n_orders), 4) AS slope, round(regr_intercept(spent, n_orders), 4) AS intercept, round(regr_r2(spent, n_orders), 6) AS r2 FROM c GROUP BY 1")
def best_fit_line(spark, d):
    return rounded(rounded(A.best_fit(_customers(spark, d), ["c_mktsegment"], "n_orders", "spent"), "r2"), "slope", "intercept", digits=4)


@query("""WITH o AS (SELECT year(o_orderdate) AS y, o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY y, r) * sum(o) OVER (PARTITION BY y, c) / sum(o) OVER (PARTITION BY y) AS e FROM o),
q AS (SELECT y, sum(o) AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc, sum((o - e) ** 2 / e) + sum(o) - sum(e) AS x FROM e GROUP BY 1)
SELECT y, n::BIGINT AS n, round(x, 6) AS chi2, (nr - 1) * (nc - 1) AS degrees, round(CASE WHEN least(nr, nc) > 1 THEN sqrt(x / (n * least(nr - 1, nc - 1))) END, 6) AS v FROM q""")
def conditional_chi2(spark, d):
    rows = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return rounded(A.conditional_chi_square(rows, "y", "o_orderstatus", "o_orderpriority").drop("p"), "chi2", "v")


GRAPH = PAIR_TABLES + ", l AS (SELECT sequence, feature, (a + 1) / (b + c + 2.0)::DOUBLE AS p, CASE WHEN a * d >= b * c THEN 1 ELSE -1 END AS direction FROM tab)"


def _links(spark, d):
    t = A.pair_tables(sharing(spark, d), species(spark, d), "sample", "sequence", "feature")
    return t.select("sequence", "feature", ((F.col("a") + 1) / (F.col("b") + F.col("c") + 2.0)).alias("p"), F.when(F.col("a") * F.col("d") >= F.col("b") * F.col("c"), 1).otherwise(-1).alias("direction"))


@query(f"""WITH {GRAPH}, e AS (SELECT sequence AS a, feature AS b, -log10(p) AS weight, direction FROM l), nodes AS (SELECT a AS node, 'a' AS side, weight, direction FROM e UNION ALL SELECT b, 'b', weight, direction FROM e)
SELECT node, side, round(max(weight), 6) AS size, arg_max(direction, struct_pack(w := weight, d := direction)) AS direction FROM nodes GROUP BY 1, 2""")
def association_nodes(spark, d):
    return rounded(A.association_graph(_links(spark, d), "sequence", "feature", "p", "direction")[0], "size")


@query(f"""WITH {GRAPH}, s AS (SELECT sequence, feature, round(p, 9) AS p FROM l), o AS (SELECT *, row_number() OVER (ORDER BY p, sequence, feature) AS k FROM s) SELECT sequence, feature, p FROM o WHERE p <= 0.05 OR k <= 100""")
def significant_or_top(spark, d):
    rows = rounded(_links(spark, d).select("sequence", "feature", "p"), "p", digits=9)
    return A.significant_or_top(rows, "p", 0.05, 100, ["sequence", "feature"])


@query(f"""WITH {GRAPH}, s AS (SELECT sequence, feature, round(-log10(p), 6) AS score FROM l), a AS (SELECT sequence FROM s GROUP BY 1 ORDER BY max(score) DESC, sequence LIMIT 20), b AS (SELECT feature FROM s GROUP BY 1 ORDER BY max(score) DESC, feature LIMIT 3)
SELECT * FROM s WHERE sequence IN (SELECT sequence FROM a) AND feature IN (SELECT feature FROM b)""")
def top_by_top(spark, d):
    rows = _links(spark, d).select("sequence", "feature", F.round(-F.log10("p"), 6).alias("score"))
    return A.top_by_top(rows, "sequence", "feature", "score", 20, 3)
