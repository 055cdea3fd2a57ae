"""Queries of cohorts, permutations, evaluation, models and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.operators import attribution, projection, selection
from cloneloom.operators import cohort as C
from cloneloom.operators import distance as D
from cloneloom.operators import ml as L
from cloneloom.plans.proxies import sharing, species, table
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.registry import query


def _people(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("age"))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey::DOUBLE AS age FROM customer),
m AS (SELECT a.c_custkey, b.c_custkey AS match, ((a.age - b.age) / 3) ** 2 + ((a.c_acctbal - b.c_acctbal) / 800) ** 2 AS dist FROM p a JOIN p b ON a.c_custkey % 10 = 0 AND b.c_custkey % 10 > 0
 AND a.c_mktsegment = b.c_mktsegment AND abs(a.age - b.age) <= 3 AND abs(a.c_acctbal - b.c_acctbal) <= 800),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, match) AS k FROM m)
SELECT p.c_custkey, match, round(sqrt(dist), 6) AS dist FROM p LEFT JOIN r ON r.c_custkey = p.c_custkey AND k = 1 WHERE p.c_custkey % 10 = 0""")
def cohort_match(spark, d):
    rows = _people(spark, d)
    found = C.nearest_match(rows.where("c_custkey % 10 = 0"), rows.where("c_custkey % 10 > 0"), "c_custkey", ["c_mktsegment"], [("age", 3.0), ("c_acctbal", 800.0)])
    return rounded(found, "dist")


@query()
def cohort_match_greedy(spark, d):
    """Without replacement, in rounds of asking and taking."""
    rows = _people(spark, d)
    return C.greedy_match(rows.where("c_custkey % 10 = 0"), rows.where("c_custkey % 10 > 0"), "c_custkey", ["c_mktsegment"], [("age", 3.0), ("c_acctbal", 800.0)])


@query("""WITH l AS (SELECT o_custkey AS usr, month(o_orderdate) AS day, o_orderkey AS blood FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT user_id AS usr, dayofmonth(ts) AS day, event_id AS stool FROM events WHERE event_type = 'signup' AND value > 50),
s AS (SELECT usr, blood, stool, 'date' AS matched_on FROM l JOIN r USING (usr, day)), u AS (SELECT * FROM s UNION ALL SELECT l.usr, blood, stool, 'user' FROM l JOIN r USING (usr) WHERE blood NOT IN (SELECT blood FROM s))
SELECT *, count(*) OVER (PARTITION BY blood) AS left_repeats, count(*) OVER (PARTITION BY stool) AS right_repeats FROM u""")
def crosswalk_fallback(spark, d):
    left = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("usr"), F.month("o_orderdate").alias("day"), F.col("o_orderkey").alias("blood"))
    right = table(spark, d, "events").where("event_type = 'signup' and value > 50").select(F.col("user_id").alias("usr"), F.dayofmonth("ts").alias("day"), F.col("event_id").alias("stool"))
    return C.crosswalk(left, right, "usr", "day", "blood", "stool").select("usr", "blood", "stool", "matched_on", "left_repeats", "right_repeats")


@query("""WITH p AS (SELECT a.s_suppkey AS sample1, b.s_suppkey AS sample2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
x AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END AS nation, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT sample1, sample2, coalesce((a.nation = b.nation)::INT, 0) AS same_nation, coalesce((a.region = b.region)::INT, 0) AS same_region, coalesce((a.nation = b.nation)::INT, 0) + coalesce((a.region = b.region)::INT, 0) AS total
FROM p JOIN x a ON a.s = sample1 JOIN x b ON b.s = sample2""")
def relation_scores(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    people = s.select(F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")).alias("nation"), F.col("n_regionkey").alias("region"))
    return C.relation_scores(D.all_pairs(people, "person", ["nation", "region"]), None, "person", ["nation", "region"])


@query("""WITH o AS (SELECT o_custkey, (o_orderstatus = 'F')::INT AS outcome, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS days, o_orderkey FROM orders) SELECT o_orderkey, outcome, days FROM o WHERE outcome = 1 OR days > 547""")
def follow_up_filter(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("outcome"), F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))
    return C.enough_follow_up(rows, "outcome", "days", 547)


SCORED = "s AS (SELECT doc_id, quality AS y, least(1.0, round(n_chars / 5000.0, 2))::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("y"), F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000.0, 2)).alias("score"), "toxic", "n_chars")


@query(f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k, score FROM s), c AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT score, sum(p) OVER o AS tp, sum(n) OVER o AS al, (SELECT sum(y) FROM s) AS pp FROM c WINDOW o AS (ORDER BY score DESC)), pr AS (SELECT tp / pp AS rec, tp / al AS prec, lag(tp / pp, 1, 0) OVER (ORDER BY score DESC) AS rec0, lag(tp / al, 1, 1) OVER (ORDER BY score DESC) AS prec0 FROM q),
x AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, sum(y) FILTER (score >= 0.5)::DOUBLE AS tp, sum(1 - y) FILTER (score >= 0.5)::DOUBLE AS fp FROM s)
SELECT n::BIGINT AS n, round(p / n, 6) AS prevalence, round(((SELECT sum(k * y) FROM r) - p * (p + 1) / 2) / (p * (n - p)), 6) AS roc_auc, round((SELECT sum((rec - rec0) * (prec + prec0) / 2) FROM pr), 6) AS pr_auc,
 round(((tp + n - p - fp) / n - ((tp + fp) * p + (n - tp - fp) * (n - p)) / (n * n)) / (1 - ((tp + fp) * p + (n - tp - fp) * (n - p)) / (n * n)), 6) AS kappa, round(2 * tp / (tp + fp + p), 6) AS f1 FROM x""")
def eval_binary(spark, d):
    return rounded(L.evaluate_binary(_scored(spark, d), [], "y", "score"), "prevalence", "roc_auc", "pr_auc", "kappa", "f1")


@query("""WITH p AS (SELECT p_brand, p_retailprice AS y, 900 + p_partkey % 1000 * 0.5 AS yp, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY p_brand ORDER BY p_partkey % 1000) + (count(*) OVER (PARTITION BY p_brand, p_partkey % 1000) - 1) / 2.0 AS ryp FROM part)
SELECT p_brand, round(corr(ry, ryp), 6) AS spearman, count(*) AS n, round(1 - sum((y - yp) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, yp), 6) AS pearson, round(1 - var_pop(y - yp) / var_pop(y), 6) AS explained_variance FROM p GROUP BY 1""")
def eval_regression(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("y"), (900 + F.col("p_partkey") % 1000 * 0.5).alias("yp"))
    return rounded(L.evaluate_regression(rows, ["p_brand"], "y", "yp", ranks=True), "spearman", "r2", "pearson", "explained_variance")


@query(f"""WITH {SCORED}, e AS (SELECT """ + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM s)
SELECT """ + " + ".join(f"(score > e{i})::INT" for i in range(1, 10)) + """ AS bin, count(*) AS n, round(avg(y), 6) AS rate FROM s, e GROUP BY 1""")
def decile_rate(spark, d):
    return rounded(L.decile_rates(_scored(spark, d), "y", "score"), "rate")


@query("""SELECT c_custkey, CASE WHEN abs(b - a) < 0.05 THEN 'no change' WHEN b - a > 0.05 AND t = 1 OR b - a < -0.05 AND t = 0 THEN 'correct' ELSE 'in correct' END AS verdict
FROM (SELECT c_custkey, (c_custkey % 17) / 17.0::DOUBLE AS a, (c_custkey % 13) / 13.0::DOUBLE AS b, c_custkey % 2 AS t FROM customer)""")
def prediction_verdict(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, L.verdict(k % 17 / 17.0, k % 13 / 13.0, k % 2).alias("verdict"))


@query("SELECT c_custkey, (('0x' || substring(md5('5:' || c_custkey), 1, 8))::BIGINT % 5)::INT AS fold FROM customer")
def fold_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.fold_of("c_custkey", 5, 5).alias("fold"))


@query("""WITH l AS (SELECT c_custkey, (c_custkey % 3 = 0)::INT AS y FROM customer), p AS (SELECT unnest(range(1, 6)) AS perm),
a AS (SELECT perm, c_custkey, y, row_number() OVER (PARTITION BY perm ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws(':', '9', perm, c_custkey)), c_custkey) AS j FROM l, p)
SELECT a.perm, a.c_custkey, b.y FROM a JOIN a b ON a.perm = b.perm AND a.i = b.j""")
def permuted_labels(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).cast("int").alias("y"))
    return L.permuted_labels(rows, "c_custkey", "y", 5, 9).withColumn("perm", F.col("perm").cast("long"))


@query()
def perm_auc(spark, d):
    return L.adaptive_auc_p(_scored(spark, d), "doc_id", "y", "score", 3)


@query("""WITH l AS (SELECT doc_id, f, v, quality FROM (SELECT doc_id, n_chars::DOUBLE AS chars, doc_id % 10 + 0.0::DOUBLE AS digit, length(lang) + doc_id % 3 + 0.0::DOUBLE AS odd FROM documents) UNPIVOT (v FOR f IN (chars, digit, odd)) JOIN labels USING (doc_id))
SELECT f, round(corr(v, quality), 6) AS r FROM l GROUP BY 1 ORDER BY abs(corr(v, quality)) DESC, f LIMIT 2""")
def select_k_best(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), (F.col("doc_id") % 10).cast("double").alias("digit"), (F.length("lang") + F.col("doc_id") % 3).cast("double").alias("odd"))
    long = docs.unpivot("doc_id", ["chars", "digit", "odd"], "f", "v").join(table(spark, d, "labels"), "doc_id")
    return rounded(L.select_k_best(long, "f", "v", "quality", 2), "r")


@query()
def pca(spark, d):
    out = L.principal_components(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 3)
    return out.select("vec_id", *[F.abs(F.col("components")[i]).alias(f"pc{i + 1}") for i in range(3)])


@query()
def pcoa(spark, d):
    """The first two principal coordinates of samples by the sequences that they share."""
    return projection.jaccard_coordinates(sharing(spark, d), "sample", "sequence", rounds=20, tolerance=1e-4).scores


@query("""WITH s AS (SELECT user_id AS sample FROM events GROUP BY 1) SELECT count(*) AS n_samples, true AS centred, true AS orthogonal, true AS variance_bounded FROM s""")
def pca_species(spark, d):
    """Components of samples x species: their scores are about 0, at right angles, and hold no more than the whole variance."""
    found = projection.principal_axes(species(spark, d), "sample", "feature", "abundance", 2)
    told = found.scores.agg(
        F.count("*").alias("n_samples"), ((F.abs(F.sum("pc1")) < 1e-6) & (F.abs(F.sum("pc2")) < 1e-6)).alias("centred"),
        (F.abs(F.sum(F.col("pc1") * F.col("pc2"))) < 1e-4 * F.sum(F.col("pc1") ** 2)).alias("orthogonal"),
    )
    return told.withColumn("variance_bounded", F.lit(bool(found.shares[0] >= found.shares[1] >= 0 and sum(found.shares) <= 1 + 1e-9)))


@query(f"""WITH {SCORED}, m AS (SELECT regr_slope(y, score) AS b, avg(score) AS m FROM s) SELECT doc_id, 'score' AS feature, score AS value, round(b * (score - m), 9) + 0.0 AS shap FROM s, m""")
def shapley_line(spark, d):
    """What the score adds to a line's prediction of quality."""
    rows = _scored(spark, d)
    slope = rows.agg(F.regr_slope("y", "score")).first()[0]
    return attribution.linear_shapley(rows, "doc_id", {"score": slope}).withColumn("shap", F.round("shap", 9) + 0.0)


@query("SELECT count(*) AS n_rows, true AS sums_to_score, 1::BIGINT AS n_bases FROM documents JOIN labels USING (doc_id)")
def shapley_trees_invariants(spark, d):
    """Shapley values of boosted trees: with the mean they add up to each row's score."""
    from cloneloom.plans.q_selection import FEATURES, text_features

    rows = text_features(spark, d)
    model = selection.fitted("binary", selection.Candidate("boosted", (("maxIter", 5), ("maxDepth", 3))), "y", selection.feature_table(rows, "doc_id", "y", FEATURES), 1)
    values = attribution.tree_shapley(rows, "doc_id", model.stages[-1], FEATURES)
    off = F.abs(F.col("base") + F.aggregate("shap", F.lit(0.0), lambda s, x: s + x) - F.col("score"))
    return values.agg(F.count("*").alias("n_rows"), (F.max(off) < 1e-9).alias("sums_to_score"), F.count_distinct("base").alias("n_bases"))


@query()
def logit_pvalues(spark, d):
    rows = _scored(spark, d).withColumn("length", F.log1p("n_chars"))
    return L.logistic_p_values(rows, "y", ["length", "toxic"])


@query()
def cv_oof_predict(spark, d):
    rows = _scored(spark, d).withColumn("length", F.log1p("n_chars"))
    return L.out_of_fold(rows, "doc_id", "y", ["length", "toxic"])


@query("""WITH v AS (SELECT 'c_nationkey' AS target, count(DISTINCT c_nationkey) AS n_values FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer)
SELECT *, CASE WHEN n_values = 2 THEN 'binary' WHEN n_values < 7 THEN 'multiclass' ELSE 'regression' END AS task FROM v""")
def task_types(spark, d):
    return L.task_type(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


# Extensions: not in the reference


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup_prod(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def ext_window_events(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def ext_sessions(spark, d):
    from cloneloom.streaming.sessions import sessions

    return sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", F.round("value", 4).alias("value"))
