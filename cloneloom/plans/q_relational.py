"""Queries of the relational core."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloneloom.operators import relational as R
from cloneloom.plans.proxies import COHORTS, REPERTOIRE, SHARING, SPECIES, cohorts, repertoire, sharing, species, table
from cloneloom.plans.registry import query


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 20 AND l_returnflag <> 'R' AND l_linestatus LIKE 'O%'""")
def scan_project_filter(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity > 10 and l_quantity <= 20 and l_returnflag <> 'R'").where(F.col("l_linestatus").startswith("O"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query(f"""WITH {REPERTOIRE}
SELECT sample, p.part, count(*) AS n, sum(templates)::BIGINT AS templates, count(DISTINCT amino_acid) AS n_aa
FROM rep, (VALUES ('Total'), ('Prod'), ('nonProd')) p(part)
WHERE p.part = 'Total' OR (p.part = 'Prod') = productive GROUP BY ALL""")
def prod_split_counts(spark, d):
    part = F.explode(F.array(F.lit("Total"), F.when(F.col("productive"), "Prod").otherwise("nonProd"))).alias("part")
    rows = repertoire(spark, d).select("sample", "templates", "amino_acid", part)
    return rows.groupBy("sample", "part").agg(F.count("*").alias("n"), F.sum("templates").alias("templates"), F.count_distinct("amino_acid").alias("n_aa"))


@query("SELECT c_custkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def join_inner(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n_name", "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def join_left(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    rows = table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH a AS (SELECT user_id AS id, count(*) AS n_events FROM events GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, n_events, n_orders, CASE WHEN b.id IS NULL THEN 'left_only' WHEN a.id IS NULL THEN 'right_only' ELSE 'both' END AS merged
FROM a FULL JOIN b ON a.id = b.id""")
def join_full_indicator(spark, d):
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    return R.join_with_indicator(a, b, ["id"]).withColumnRenamed("_merge", "merged")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def join_semi(spark, d):
    buyers = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(buyers, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def join_anti(spark, d):
    still = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(still, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT user_id, d, n_events, n_orders FROM
(SELECT user_id, month(ts) AS d, count(*) AS n_events FROM events GROUP BY ALL) JOIN
(SELECT o_custkey, month(o_orderdate) AS m, count(*) AS n_orders FROM orders GROUP BY ALL) ON user_id = o_custkey AND d = m""")
def join_multikey(spark, d):
    a = table(spark, d, "events").groupBy("user_id", F.month("ts").cast("long").alias("d")).agg(F.count("*").alias("n_events"))
    b = table(spark, d, "orders").groupBy("o_custkey", F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n_orders"))
    return a.join(b, (F.col("user_id") == F.col("o_custkey")) & (F.col("d") == F.col("m"))).select("user_id", "d", "n_events", "n_orders")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, x.n_name AS a_name, y.n_name AS b_name FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey JOIN nation x ON a.s_nationkey = x.n_nationkey JOIN nation y ON b.s_nationkey = y.n_nationkey""")
def lookup_both_ends(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    names = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("name"))
    a, b = s.select(F.col("s_suppkey").alias("a"), "s_nationkey"), s.select(F.col("s_suppkey").alias("b"), "s_nationkey")
    edges = a.join(b, "s_nationkey").where("a < b").select("a", "b")
    return R.lookup_both_ends(edges, names, ("a", "b"), "key", "name")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'event', event_id, NULL FROM events")
def union_all(spark, d):
    pick = lambda t, kind, key, name=None: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), *([F.col(name).alias("name")] if name else []))
    return pick("customer", "customer", "c_custkey", "c_name").unionByName(pick("supplier", "supplier", "s_suppkey", "s_name")).unionByName(pick("events", "event", "event_id"), allowMissingColumns=True)


@query(f"""WITH {SHARING}, {COHORTS}, m AS (SELECT sequence AS k, bit_or(1 << cohort) AS mask FROM share JOIN cohorts USING (sample) GROUP BY 1)
SELECT count(*) FILTER (mask & 1 > 0) AS n_left, count(*) FILTER (mask & 2 > 0) AS n_right, count(*) FILTER (mask = 3) AS n_both,
 count(*) FILTER (mask = 1) AS n_left_only, count(*) FILTER (mask = 2) AS n_right_only, count(*) AS n_union,
 round(100.0 * count(*) FILTER (mask = 3) / count(*) FILTER (mask & 1 > 0), 6)::DOUBLE AS pct_left,
 round(100.0 * count(*) FILTER (mask = 3) / count(*) FILTER (mask & 2 > 0), 6)::DOUBLE AS pct_right FROM m""")
def set_intersect_except(spark, d):
    rows = sharing(spark, d).join(cohorts(spark, d), "sample")
    out = R.overlap_counts(rows.where("cohort = 0"), rows.where("cohort = 1"), "sequence")
    return out.withColumn("pct_left", F.round("pct_left", 6)).withColumn("pct_right", F.round("pct_right", 6))


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS first_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_keep_first(spark, d):
    return R.keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("first_date"))


@query(f"""WITH {SHARING}, top AS (SELECT sequence FROM share GROUP BY 1 ORDER BY count(*) DESC, sequence LIMIT 25)
SELECT sample, sequence, round(frequency, 4) AS frequency FROM share WHERE sequence IN (SELECT sequence FROM top)""")
def topn_features(spark, d):
    return R.top_features(sharing(spark, d), "sequence", 25).select("sample", "sequence", F.round("frequency", 4).alias("frequency"))


@query(f"""WITH {SHARING}, c AS (SELECT sequence, count(*) AS n FROM share GROUP BY 1)
SELECT sequence, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 99""")
def cutoff_with_ties(spark, d):
    counts = sharing(spark, d).groupBy("sequence").agg(F.count("*").alias("n"))
    return R.cutoff_with_ties(counts, "n", 99)


@query("""SELECT o_orderkey, CASE month(o_orderdate) WHEN 12 THEN 'winter' WHEN 1 THEN 'winter' WHEN 2 THEN 'winter' WHEN 3 THEN 'spring' WHEN 4 THEN 'spring' WHEN 5 THEN 'spring'
 WHEN 6 THEN 'summer' WHEN 7 THEN 'summer' WHEN 8 THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def recode_map(spark, d):
    seasons = {m: ("winter", "spring", "summer", "autumn")[m % 12 // 3] for m in range(1, 13)}
    return table(spark, d, "orders").withColumn("m", F.month("o_orderdate")).select("o_orderkey", R.recode("m", seasons).alias("season"))


@query("""WITH p AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1)
SELECT c_custkey, round(coalesce(c.v, p.v, c_acctbal), 4) AS score FROM customer LEFT JOIN c ON c.user_id = c_custkey LEFT JOIN p ON p.user_id = c_custkey""")
def coalesce_first(spark, d):
    best = lambda kind, name: table(spark, d, "events").where(kind).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias(name))
    rows = table(spark, d, "customer").join(best("event_type = 'click' and value > 90", "c"), "c_custkey", "left").join(best("event_type = 'purchase'", "p"), "c_custkey", "left")
    return rows.select("c_custkey", F.round(F.coalesce("c", "p", "c_acctbal"), 4).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 5000 THEN c_acctbal END AS balance FROM customer")
def mask_range(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.mask_range("c_acctbal", 0, 5000).alias("balance"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, (SELECT min(l_discount) FROM lineitem WHERE l_discount > 0)) AS l_discount FROM lineitem")
def cap_floor(spark, d):
    return R.floor_at_least_positive(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query(f"WITH {SPECIES} SELECT sample, feature, (abundance > 0.2)::INT AS present FROM species")
def binarize_threshold(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("feature"), "value")
    return R.share_above(rows, "sample", ["feature"], "value", 0.2, "present")


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS n FROM customer)
SELECT c_custkey, round(coalesce(a, (SELECT median(a) FROM m)), 4) AS a, round(coalesce(b, (SELECT avg(b) FROM m)), 4) AS b, coalesce(n, -1) AS n FROM m""")
def fill_policy(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("b"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")).alias("n")
    )
    return R.fill_by_policy(rows, {"a": "median", "b": "mean", "n": -1}).withColumn("a", F.round("a", 4)).withColumn("b", F.round("b", 4))


@query("SELECT page_id, unnest(list_filter(string_split(url, '/'), lambda x: trim(x) <> '')) AS item FROM pages")
def explode_list(spark, d):
    return R.explode_list(table(spark, d, "pages").select("page_id", "url"), "url", "item", "/").select("page_id", "item")


@query(f"WITH {REPERTOIRE} SELECT sample, sum(templates)::BIGINT AS n_rows, count(*) AS n_clones, sum(templates * (templates + 1) // 2)::BIGINT AS copy_sum FROM rep GROUP BY 1")
def expand_counts(spark, d):
    rows = R.expand_counts(repertoire(spark, d).select("sample", "nucleotide", "templates"), "templates")
    return rows.groupBy("sample").agg(F.count("*").alias("n_rows"), F.sum((F.col("copy") == 1).cast("long")).alias("n_clones"), F.sum("copy").alias("copy_sum"))


@query(f"""WITH {SPECIES} SELECT sample, round(max(abundance) FILTER (feature = 'click'), 6) AS click, round(max(abundance) FILTER (feature = 'view'), 6) AS view,
 round(max(abundance) FILTER (feature = 'error'), 6) AS error FROM species GROUP BY 1""")
def pivot_usage(spark, d):
    rows = species(spark, d).withColumn("abundance", F.round("abundance", 6))
    return R.pivot_unique(rows, "sample", "feature", "abundance", ["click", "view", "error"])


@query("SELECT c_custkey, feature, value FROM (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (value FOR feature IN (balance, nation))")
def melt_features(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return rows.unpivot("c_custkey", ["balance", "nation"], "feature", "value").where("value is not null")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in SEGMENTS[1:]) + " FROM customer")
def dummies(spark, d):
    return R.dummies(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS).drop("c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'low' WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 'mid' WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'high' END AS level FROM customer")
def bin_cut(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.cut("c_acctbal", [-1000, 0, 5000, 10000], ["low", "mid", "high"]).alias("level"))


@query("""WITH e AS (SELECT unnest(list_transform(range(1, 10), lambda i: i / 10.0)) AS q), x AS (SELECT quantile_cont(c_acctbal, 0.1) a1, quantile_cont(c_acctbal, 0.2) a2, quantile_cont(c_acctbal, 0.3) a3, quantile_cont(c_acctbal, 0.4) a4,
 quantile_cont(c_acctbal, 0.5) a5, quantile_cont(c_acctbal, 0.6) a6, quantile_cont(c_acctbal, 0.7) a7, quantile_cont(c_acctbal, 0.8) a8, quantile_cont(c_acctbal, 0.9) a9 FROM customer)
SELECT c_custkey, (c_acctbal > a1)::INT + (c_acctbal > a2)::INT + (c_acctbal > a3)::INT + (c_acctbal > a4)::INT + (c_acctbal > a5)::INT + (c_acctbal > a6)::INT + (c_acctbal > a7)::INT + (c_acctbal > a8)::INT + (c_acctbal > a9)::INT AS bin FROM customer, x""")
def bin_qcut(spark, d):
    return R.qcut(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).select("c_custkey", "bin")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority")
def crosstab_norm(spark, d):
    return R.crosstab_share(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("share", F.round("share", 6))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS size_rank FROM part")
def average_rank(spark, d):
    return table(spark, d, "part").select("p_partkey", R.average_rank("p_size", ["p_brand"], descending=True).alias("size_rank"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_of_customer, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def group_count_cumsum(spark, d):
    own = Window.partitionBy("o_custkey")
    running = own.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(own).alias("n_of_customer"), F.round(F.sum("o_totalprice").over(running), 2).alias("running"))


@query("""WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, abs(a.n_regionkey - b.n_regionkey) AS dist FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)
SELECT a, b, dist FROM p UNION ALL SELECT b, a, dist FROM p""")
def square_condensed(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    return R.square(a.join(b, F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("ra") - F.col("rb")).alias("dist")), "a", "b", "dist")


@query("""SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS p
FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def merge_many_frames(spark, d):
    one = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return R.merge_many({"f": one("F"), "o": one("O"), "p": one("P")}, ["id"], "n")
