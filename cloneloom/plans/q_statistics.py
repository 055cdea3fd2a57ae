"""Queries of distances, tests and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.operators import distance as D
from cloneloom.operators import linkage
from cloneloom.operators import stats as S
from cloneloom.plans.proxies import COHORTS, REPERTOIRE, SHARING, SPECIES, cohorts, repertoire, sharing, species, table
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.registry import query
from cloneloom.plans.tails import chi2_tail, f_tail, ks_tail, normal_tail, t_tail

# Distances

@query(f"""WITH {SHARING}, n AS (SELECT sample, count(*) AS n FROM share GROUP BY 1), b AS (SELECT a.sample AS s1, c.sample AS s2, count(*) AS k FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL)
SELECT x.sample AS sample1, y.sample AS sample2, round(1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) AS dist FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON s1 = x.sample AND s2 = y.sample""")
def dist_jaccard(spark, d):
    return rounded(D.jaccard(sharing(spark, d), "sample", "sequence"), "dist")


def _linked(spark, d):
    return linkage.average_linkage(D.jaccard(sharing(spark, d), "sample", "sequence"))


@query()
def linkage_order(spark, d):
    """The samples in the leaf order of the average linkage of their Jaccard distances."""
    return _linked(spark, d).order


@query(f"""WITH {SHARING}, n AS (SELECT sample, count(*) AS n FROM share GROUP BY 1), b AS (SELECT a.sample AS s1, c.sample AS s2, count(*) AS k FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL),
p AS (SELECT 1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) AS dist FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON s1 = x.sample AND s2 = y.sample)
SELECT (SELECT count(*) FROM n) AS n_leaves, (SELECT count(*) FROM n) - 1 AS n_merges, (SELECT count(*) FROM p) AS n_pairs, (SELECT round(sum(dist), 6) FROM p) AS all_distances, (SELECT round(min(dist), 9) FROM p) AS lowest, 0::BIGINT AS n_sinking, (SELECT count(*) FROM n) AS n_places""")
def linkage_invariants(spark, d):
    """Merges meet each pair of samples once, at the mean of its distances, and no merge is lower than those that it joins."""
    tree = _linked(spark, d)
    m = tree.merges
    parts = m.select("round", "height", F.explode(F.array("first", "second")).alias("cluster"))
    below = m.select(F.col("first").alias("cluster"), F.col("round").alias("_round"), F.col("height").alias("_height"))
    sinking = parts.join(below, "cluster").where("_round < round and _height > height + 1e-12").agg(F.count("*").alias("n_sinking"))
    met = F.col("n_first") * F.col("n_second")
    told = m.agg(F.count("*").alias("n_merges"), F.sum(met).alias("n_pairs"), F.round(F.sum(F.col("height") * met), 6).alias("all_distances"), F.round(F.min("height"), 9).alias("lowest"))
    places = tree.order.agg(F.count("*").alias("n_leaves"), F.count_distinct(F.when(F.col("place").between(1, told.select("n_merges").first()[0] + 1), F.col("place"))).alias("n_places"))
    return told.crossJoin(places).crossJoin(sinking)  # one row each


@query(f"""WITH {SHARING}, n AS (SELECT sample, sum(frequency) AS t FROM share GROUP BY 1), b AS (SELECT a.sample AS s1, c.sample AS s2, sum(least(a.frequency, c.frequency)) AS low FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL)
SELECT x.sample AS sample1, y.sample AS sample2, round(1 - 2 * coalesce(low, 0) / (x.t + y.t), 6) AS dist FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON s1 = x.sample AND s2 = y.sample""")
def dist_braycurtis(spark, d):
    return rounded(D.bray_curtis(sharing(spark, d), "sample", "sequence", "frequency"), "dist")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS sample1, b.vec_id AS sample2, round(list_distance(a.e, b.e), 6) AS euclidean, round(list_distance(a.e, b.e) ** 2, 6) AS sqeuclidean,
 round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))), 6) AS cityblock, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) > 0 THEN abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) ELSE 0 END)), 6) AS canberra,
 round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] <> z[2])::INT)) / len(a.e), 6) AS hamming
FROM v a JOIN v b ON a.vec_id < b.vec_id""")
def dist_dense(spark, d):
    return D.dense_distances(table(spark, d, "embeddings"), "vec_id", "embedding", digits=6)


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_date FROM orders GROUP BY 1)
SELECT a.o_custkey AS sample1, b.o_custkey AS sample2, abs(date_diff('day', a.first_date, b.first_date)) AS dist FROM f a JOIN f b ON a.o_custkey < b.o_custkey""")
def date_pair_days(spark, d):
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("day"))
    return D.all_pairs(f, "o_custkey", ["day"]).select("sample1", "sample2", F.abs(F.datediff("day1", "day2")).cast("long").alias("dist"))


@query(f"""WITH {SHARING}, p AS (SELECT a.sample AS sample1, c.sample AS sample2, count(*)::DOUBLE AS dist FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY dist, sample1, sample2) AS place FROM p""")
def pairs_ordered(spark, d):
    return D.ordered_shared(sharing(spark, d), "sample", "sequence")


@query(f"""WITH {SHARING}, {COHORTS}, p AS (SELECT a.sample AS sample1, c.sample AS sample2, count(*) AS n FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL)
SELECT x.cohort + y.cohort AS n_flagged, count(*) AS n_pairs, round(avg(n), 6) AS mean FROM p JOIN cohorts x ON x.sample = sample1 JOIN cohorts y ON y.sample = sample2 GROUP BY 1""")
def pair_classes(spark, d):
    from cloneloom.operators.repertoire import shared_pairs

    rows = D.pair_classes(shared_pairs(sharing(spark, d), "sample", "sequence", cohorts(spark, d)), cohorts(spark, d), "sample", "cohort")
    return rounded(rows.groupBy("n_flagged").agg(F.count("*").alias("n_pairs"), F.avg("n_shared").alias("mean")), "mean")


@query(f"""WITH {SHARING}, {COHORTS}, g AS (SELECT sample, cohort FROM cohorts WHERE sample IN (SELECT sample FROM share)), n AS (SELECT sample, count(*) AS n FROM share GROUP BY 1),
b AS (SELECT a.sample AS s1, c.sample AS s2, count(*) AS k FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL),
p AS (SELECT x.sample AS s1, y.sample AS s2, 1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) AS dist FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON b.s1 = x.sample AND b.s2 = y.sample),
z AS (SELECT cohort, count(*) AS k FROM g GROUP BY 1), q AS (SELECT sum(dist ** 2) AS total, sum(dist ** 2 / z.k) FILTER (g1.cohort = g2.cohort) AS within FROM p JOIN g g1 ON g1.sample = s1 JOIN g g2 ON g2.sample = s2 JOIN z ON z.cohort = g1.cohort)
SELECT (SELECT sum(k) FROM z)::BIGINT AS n, (SELECT count(*) FROM z) AS groups, round((total / (SELECT sum(k) FROM z) - within) / ((SELECT count(*) FROM z) - 1) / (within / ((SELECT sum(k) FROM z) - (SELECT count(*) FROM z))), 6) AS f FROM q""")
def permanova_f(spark, d):
    few = sharing(spark, d)
    groups = cohorts(spark, d).join(few.select("sample").distinct(), "sample", "left_semi")
    return rounded(D.permanova_f(D.jaccard(few, "sample", "sequence", groups.withColumnRenamed("cohort", "g")), groups, "sample", "cohort"), "f")


@query(f"""WITH {SHARING}, n AS (SELECT sample, count(*) AS n, sum(frequency) AS t FROM share GROUP BY 1),
b AS (SELECT a.sample AS s1, c.sample AS s2, count(*) AS k, sum(least(a.frequency, c.frequency)) AS low FROM share a JOIN share c ON a.sequence = c.sequence AND a.sample < c.sample GROUP BY ALL),
p AS (SELECT 1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)) AS j, 1 - 2 * coalesce(low, 0) / (x.t + y.t) AS bc FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN b ON s1 = x.sample AND s2 = y.sample)
SELECT count(*) AS n, round(corr(j, bc), 6) AS r FROM p""")
def mantel_r(spark, d):
    return rounded(D.mantel_both(sharing(spark, d), "sample", "sequence", "frequency"), "r")


# Tests

CUSTOMER = "c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, (c_custkey % 3 = 0)::INT AS grp, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


def _customers(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = rows.groupBy("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spent"))
    return out.withColumn("grp", (F.col("c_custkey") % 3 == 0).cast("int"))


R_TO_P = f"u AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS v FROM q) SELECT c_mktsegment, n, round(r, 6) AS r, round({t_tail('t', 'v')}, 6) AS p FROM u"


@query(f"WITH {CUSTOMER}, q AS (SELECT c_mktsegment, count(*) AS n, corr(c_acctbal, spent) AS r FROM c GROUP BY 1), {R_TO_P}")
def pearson_pairs(spark, d):
    return rounded(S.correlations(_customers(spark, d), ["c_mktsegment"], "c_acctbal", "spent"), "r", "p")


@query(f"""WITH {CUSTOMER}, r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS x,
 rank() OVER (PARTITION BY c_mktsegment ORDER BY n_orders) + (count(*) OVER (PARTITION BY c_mktsegment, n_orders) - 1) / 2.0 AS y FROM c), q AS (SELECT c_mktsegment, count(*) AS n, corr(x, y) AS r FROM r GROUP BY 1), {R_TO_P}""")
def spearman_pairs(spark, d):
    return rounded(S.correlations(_customers(spark, d), ["c_mktsegment"], "c_acctbal", "n_orders", "spearman"), "r", "p")


@query(f"""WITH {CUSTOMER}, r AS (SELECT c_mktsegment, grp, count(*) OVER (PARTITION BY c_mktsegment, n_orders) AS ties, rank() OVER (PARTITION BY c_mktsegment ORDER BY n_orders) + (count(*) OVER (PARTITION BY c_mktsegment, n_orders) - 1) / 2.0 AS k FROM c),
q AS (SELECT c_mktsegment, sum(grp)::BIGINT AS n1, sum(1 - grp)::BIGINT AS n2, (sum(k * grp) - sum(grp) * (sum(grp) + 1) / 2)::DOUBLE AS u1, (sum(grp) * sum(1 - grp) - sum(k * grp) + sum(grp) * (sum(grp) + 1) / 2)::DOUBLE AS u2, sum(ties * ties - 1.0) AS t FROM r GROUP BY 1),
z AS (SELECT *, greatest(abs(u1 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM q)
SELECT c_mktsegment, n1, n2, u1, u2, round({normal_tail('z')}, 6) AS p FROM z""")
def mw_u(spark, d):
    return rounded(S.mann_whitney(_customers(spark, d), ["c_mktsegment"], "n_orders", "grp").select("c_mktsegment", "n1", "n2", "u1", "u2", "p"), "p")


@query(f"""WITH {CUSTOMER}, a AS (SELECT c_mktsegment, count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 0) AS n0, avg(c_acctbal) FILTER (grp = 1) AS m1, avg(c_acctbal) FILTER (grp = 0) AS m0, var_samp(c_acctbal) FILTER (grp = 1) AS v1, var_samp(c_acctbal) FILTER (grp = 0) AS v0 FROM c GROUP BY 1),
u AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t, n1 + n0 - 2 AS v FROM a)
SELECT c_mktsegment, n1, n0, round(t, 6) AS t, round({t_tail('t', 'v')}, 6) AS p FROM u""")
def ttest_stat(spark, d):
    return rounded(S.t_test(_customers(spark, d), ["c_mktsegment"], "c_acctbal", "grp").select("c_mktsegment", "n1", "n0", "t", "p"), "t", "p")


@query(f"""WITH {CUSTOMER}, g AS (SELECT grp, c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM c GROUP BY ALL), t AS (SELECT grp, avg(c_acctbal) AS gm FROM c GROUP BY 1),
a AS (SELECT grp, count(*) AS groups, sum(n)::BIGINT AS n, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM g JOIN t USING (grp) GROUP BY grp)
SELECT grp, groups, n, round(f, 5) AS f, round({f_tail('f', 'd1', 'd2')}, 6) AS p FROM a""")
def anova_f(spark, d):
    return rounded(rounded(S.anova(_customers(spark, d), ["grp"], "c_acctbal", "c_mktsegment"), "f", digits=5), "p")


@query(f"""WITH {CUSTOMER}, v AS (SELECT DISTINCT c_mktsegment, c_acctbal AS x FROM c), e AS (SELECT v.c_mktsegment, v.x, count(*) FILTER (grp = 1 AND c_acctbal <= v.x) / count(*) FILTER (grp = 1) AS a, count(*) FILTER (grp = 0 AND c_acctbal <= v.x) / count(*) FILTER (grp = 0) AS b FROM v JOIN c USING (c_mktsegment) GROUP BY ALL),
k AS (SELECT e.c_mktsegment, max(abs(a - b)) AS d, any_value(n) AS n, any_value(m) AS m FROM e JOIN (SELECT c_mktsegment, sum(grp)::BIGINT AS n, sum(1 - grp)::BIGINT AS m FROM c GROUP BY 1) USING (c_mktsegment) GROUP BY 1)
SELECT c_mktsegment, round(d, 6) AS d, round({ks_tail('d', 'n', 'm')}, 6) AS p FROM k""")
def ks_d(spark, d):
    return rounded(S.ks_two_sample(_customers(spark, d), ["c_mktsegment"], "c_acctbal", "grp").select("c_mktsegment", "d", "p"), "d", "p")


@query(f"""WITH o AS (SELECT o_orderstatus, o_orderpriority, count(*) AS o FROM orders GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY o_orderstatus) * sum(o) OVER (PARTITION BY o_orderpriority) / sum(o) OVER () AS e FROM o),
q AS (SELECT sum(o)::BIGINT AS n, sum((o - e) ** 2 / e) AS chi2, (count(DISTINCT o_orderstatus) - 1) * (count(DISTINCT o_orderpriority) - 1) AS degrees, round(sqrt(sum((o - e) ** 2 / e) / (sum(o) * least(count(DISTINCT o_orderstatus) - 1, count(DISTINCT o_orderpriority) - 1))), 6) AS v FROM e)
SELECT n, round(chi2, 6) AS chi2, degrees, v, round({chi2_tail('chi2', 'degrees')}, 6) AS p FROM q""")
def chi2_stat(spark, d):
    return rounded(S.chi_square(table(spark, d, "orders"), [], "o_orderstatus", "o_orderpriority"), "chi2", "v", "p")


TABLES = REPERTOIRE + ", tab AS (SELECT v_gene, count(*) FILTER (productive AND status = 'O') AS a, count(*) FILTER (productive AND status <> 'O') AS b, count(*) FILTER (NOT productive AND status = 'O') AS c, count(*) FILTER (NOT productive AND status <> 'O') AS d FROM rep GROUP BY 1)"


def _tables(spark, d):
    n = lambda p: F.sum(F.expr(p).cast("long"))
    return repertoire(spark, d).groupBy("v_gene").agg(
        n("productive and status = 'O'").alias("a"), n("productive and status <> 'O'").alias("b"), n("not productive and status = 'O'").alias("c"), n("not productive and status <> 'O'").alias("d")
    )


@query(f"""WITH {TABLES}, k AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM tab),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - CASE WHEN a + b = k THEN 0 ELSE lgamma(a + b - k + 1) END - CASE WHEN a + c = k THEN 0 ELSE lgamma(a + c - k + 1) END - CASE WHEN d - a + k = 0 THEN 0 ELSE lgamma(d - a + k + 1) END) AS p FROM k),
o AS (SELECT *, max(p) FILTER (k = a) OVER (PARTITION BY v_gene) AS own FROM p)
SELECT v_gene, a, b, c, d, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS p, round(CASE WHEN b * c > 0 THEN a * d / (b * c) ELSE 999999 END, 6) AS odds_ratio FROM o GROUP BY v_gene, a, b, c, d""")
def fisher_p(spark, d):
    return rounded(S.fisher_exact(_tables(spark, d), "a", "b", "c", "d"), "p", "odds_ratio")


@query(f"""WITH {TABLES}, l AS (SELECT *, CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN ln(a * d / (b * c)) END AS lo, CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS h FROM tab)
SELECT v_gene, a, b, c, d, round(exp(lo), 6) AS odds_ratio, round(exp(lo - h), 6) AS ci_low, round(exp(lo + h), 6) AS ci_high, exp(lo - h) > 1 OR exp(lo + h) < 1 AS significant FROM l""")
def odds_ratio_ci(spark, d):
    return rounded(S.odds_ratio_ci(_tables(spark, d), "a", "b", "c", "d"), "odds_ratio", "ci_low", "ci_high")


def _p_values(spark, d):
    return table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1009 + 1) / 1010.0 * F.col("p_size") / 50.0).alias("p"))


P_VALUES = "t AS (SELECT p_partkey, (p_partkey * 7919 % 1009 + 1) / 1010.0::DOUBLE * p_size / 50.0::DOUBLE AS p FROM part)"


@query(f"""WITH {P_VALUES}, r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, row_number() OVER (ORDER BY p) AS k FROM t)
SELECT p_partkey, round(least(1, min(q) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM r""")
def bh_fdr(spark, d):
    return rounded(S.adjusted(_p_values(spark, d), "p", "bh").select("p_partkey", "p_adjusted"), "p_adjusted")


@query(f"WITH {P_VALUES} SELECT p_partkey, round(least(1, p * count(*) OVER ()), 6) AS p_adjusted, p * count(*) OVER () <= 0.05 AS significant FROM t")
def bonferroni_flag(spark, d):
    out = S.adjusted(_p_values(spark, d), "p", "bonferroni").withColumn("significant", F.col("p_adjusted") <= 0.05)
    return rounded(out.select("p_partkey", "p_adjusted", "significant"), "p_adjusted")


@query(f"""WITH {P_VALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t)
SELECT p_partkey, round(least(1, max(1 - (1 - p) ** (n - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM r""")
def holm_sidak(spark, d):
    return rounded(S.adjusted(_p_values(spark, d), "p", "holm-sidak").select("p_partkey", "p_adjusted"), "p_adjusted")


@query(f"WITH {CUSTOMER}, l AS (SELECT regr_slope(spent, n_orders) AS b, regr_intercept(spent, n_orders) AS a FROM c WHERE grp = 0) SELECT c_custkey, round(spent - a - b * n_orders, 3) AS residual FROM c, l")
def residualize(spark, d):
    return rounded(S.residuals(_customers(spark, d), "spent", "n_orders", F.col("grp") == 0).select("c_custkey", "residual"), "residual", digits=3)


@query(f"WITH {CUSTOMER}, s AS (SELECT avg(spent) AS m, stddev_samp(spent) AS s FROM c) SELECT c_custkey, round(CASE WHEN abs(spent - m) <= 1.5 * s THEN spent END, 2) AS spent FROM c, s")
def outlier_filter(spark, d):
    return rounded(S.outlier_mask(_customers(spark, d).select("c_custkey", "spent"), ["spent"], 1.5), "spent", digits=2)


@query(f"""WITH {CUSTOMER}, w AS (SELECT *, avg(spent) OVER x AS m, stddev_pop(spent) OVER x AS s, count(*) OVER x AS n FROM c WINDOW x AS (PARTITION BY c_nationkey))
SELECT c_nationkey, round(coalesce(avg(spent) FILTER (n <= 3 OR s = 0 OR abs(spent - m) <= 2 * s), avg(spent)), 4) AS mean FROM w GROUP BY 1""")
def no_outlier_mean(spark, d):
    return rounded(S.no_outlier_mean(_customers(spark, d), ["c_nationkey"], "spent", 2, 3), "mean", digits=4)


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal_z, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal_unit FROM customer")
def zscore_minmax(spark, d):
    return rounded(S.scaled(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).drop("c_acctbal"), "c_acctbal_z", "c_acctbal_unit")


# Associations


@query(f"""WITH {SHARING}, {COHORTS}, z AS (SELECT sequence, sample, cohort, coalesce(frequency, 0) AS v FROM (SELECT DISTINCT sequence FROM share) CROSS JOIN cohorts LEFT JOIN share USING (sequence, sample)),
r AS (SELECT *, rank() OVER (PARTITION BY sequence ORDER BY v) + (count(*) OVER (PARTITION BY sequence, v) - 1) / 2.0 AS k FROM z)
SELECT sequence AS feature, count(*) FILTER (cohort = 1 AND v > 0) AS present1, count(*) FILTER (cohort = 1 AND v = 0) AS absent1, count(*) FILTER (cohort = 0 AND v > 0) AS present0, count(*) FILTER (cohort = 0 AND v = 0) AS absent0,
 round(avg(v) FILTER (cohort = 1), 3) AS mean1, round(avg(v) FILTER (cohort = 0), 3) AS mean0, (sum(k * cohort) - sum(cohort) * (sum(cohort) + 1) / 2)::DOUBLE AS u1 FROM r GROUP BY 1""")
def assoc_binary_nonbinary(spark, d):
    cells = sharing(spark, d).withColumnRenamed("sequence", "feature")
    out = S.binary_association(cells, cohorts(spark, d), "sample", "feature", "frequency", "cohort")
    return rounded(out.select("feature", "present1", "absent1", "present0", "absent0", "mean1", "mean0", "u1"), "mean1", "mean0", digits=3)


@query()
def cluster_enrichment(spark, d):
    """Fisher, Mann-Whitney, both corrections and the signed log p of every feature."""
    cells = sharing(spark, d).withColumnRenamed("sequence", "feature")
    out = S.binary_association(cells, cohorts(spark, d), "sample", "feature", "frequency", "cohort").cache()  # each correction reads it several times
    out = S.adjusted(S.adjusted(out, "p_fisher", "bh", out="fdr_fisher").cache(), "p_mw", "bh", out="fdr_mw")
    return out.withColumn("signed_log_p", S.signed_log_p("p_fisher", "direction"))


@query(f"""WITH {SPECIES}, m AS (SELECT feature AS species, (sample % 7) AS cluster, sign(round(avg(abundance) - 0.2, 4)) AS c_s FROM species GROUP BY ALL), p AS (SELECT sample % 7 AS cluster, sample % 3 AS phenotype, sign(round(avg(abundance) FILTER (feature = 'click') - 0.2, 4)) AS c_p FROM species GROUP BY ALL),
q AS (SELECT feature AS species, sample % 3 AS phenotype, sign(round(avg(abundance) - 0.2, 4)) AS s_p FROM species GROUP BY ALL)
SELECT cluster, species, phenotype, c_s::DOUBLE AS c_s, c_p::DOUBLE AS c_p, s_p::DOUBLE AS s_p, CASE WHEN c_s = s_p + c_p THEN 0 ELSE 1 END AS direction_ok FROM m JOIN p USING (cluster) JOIN q USING (species, phenotype)""")
def triad_merge(spark, d):
    rows = species(spark, d).withColumn("cluster", F.col("sample") % 7).withColumn("phenotype", F.col("sample") % 3)
    way = lambda c: F.signum(F.round(F.avg(c) - 0.2, 4))
    cs = rows.groupBy("cluster", F.col("feature").alias("species")).agg(way("abundance").alias("c_s"))
    cp = rows.groupBy("cluster", "phenotype").agg(way(F.when(F.col("feature") == "click", F.col("abundance"))).alias("c_p"))
    sp = rows.groupBy(F.col("feature").alias("species"), "phenotype").agg(way("abundance").alias("s_p"))
    return S.merge_triads(cs, cp, sp).select("cluster", "species", "phenotype", "c_s", "c_p", "s_p", "direction_ok")
