"""Queries of repertoire features, sharing and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloneloom.operators import relational as R
from cloneloom.operators import repertoire as P
from cloneloom.plans.proxies import COHORTS, REPERTOIRE, SHARING, SPECIES, cohorts, repertoire, sharing, species, table
from cloneloom.plans.registry import query

SHARES = REPERTOIRE + """,
clones AS (SELECT sample, nucleotide, sum(templates) AS w, sum(templates) / sum(sum(templates)) OVER (PARTITION BY sample) AS p FROM rep GROUP BY sample, nucleotide)"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {SHARES} SELECT sample, count(*) AS richness, sum(w)::BIGINT AS total, round(-sum(p * log2(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, round(max(p), 6) AS berger_parker
FROM clones GROUP BY 1""")
def repertoire_diversity(spark, d):
    return rounded(P.diversity(repertoire(spark, d), "sample", "nucleotide", "templates"), "shannon", "simpson", "berger_parker")


@query(f"""WITH {SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p DESC, nucleotide) AS n FROM clones)
SELECT sample, round(sum(p) FILTER (n <= 1), 6) AS top_1, CASE WHEN count(*) >= 10 THEN round(sum(p) FILTER (n <= 10), 6) END AS top_10,
 CASE WHEN count(*) >= 1000 THEN round(sum(p) FILTER (n <= 1000), 6) END AS top_1000 FROM r GROUP BY 1""")
def clonality_topk(spark, d):
    shares = P.clone_shares(repertoire(spark, d), "sample", "nucleotide", "templates")
    return rounded(P.top_clones(shares, "sample", [1, 10, 1000], "nucleotide"), "top_1", "top_10", "top_1000")


@query(f"""WITH {SHARES} SELECT sample, round(quantile_cont(p, 0.01), 12) AS p1, round(quantile_cont(p, 0.5), 12) AS p50, round(quantile_cont(p, 0.999), 12) AS p99_9,
 round(avg(p), 12) AS mean, round(stddev_pop(p), 12) AS std FROM clones GROUP BY 1""")
def clonality_percentiles(spark, d):
    shares = P.clone_shares(repertoire(spark, d), "sample", "nucleotide", "templates")
    return rounded(P.clone_percentiles(shares, "sample"), "p1", "p50", "p99_9", "mean", "std", digits=12)


@query(f"""WITH {REPERTOIRE} SELECT sample, round(avg(cdr3_length), 6) AS cdr3_length_mean, round(stddev_samp(cdr3_length), 6) AS cdr3_length_std, max(cdr3_length) AS cdr3_length_max,
 round(avg(v_deletion), 6) AS v_deletion_mean, round(stddev_samp(v_deletion), 6) AS v_deletion_std, round(max(v_deletion), 6) AS v_deletion_max FROM rep GROUP BY 1""")
def length_stats(spark, d):
    out = P.column_stats(repertoire(spark, d), "sample", ["cdr3_length", "v_deletion"])
    return rounded(out, "cdr3_length_mean", "cdr3_length_std", "v_deletion_mean", "v_deletion_std", "v_deletion_max")


@query(f"""WITH {REPERTOIRE} SELECT sample, round(stddev_pop(cdr3_length) / avg(cdr3_length), 6) AS cdr3_length_cv, round(stddev_pop(v_deletion) / nullif(avg(v_deletion), 0), 6) AS v_deletion_cv,
 round(stddev_pop(j_deletion) / nullif(avg(j_deletion), 0), 6) AS j_deletion_cv FROM rep GROUP BY 1""")
def cv_features(spark, d):
    cols = ["cdr3_length", "v_deletion", "j_deletion"]
    return rounded(P.coefficient_of_variation(repertoire(spark, d), "sample", cols), *[f"{c}_cv" for c in cols])


@query(f"""WITH {REPERTOIRE}, c AS (SELECT sample, amino_acid, count(DISTINCT nucleotide) AS n FROM rep GROUP BY ALL)
SELECT sample, max(n) AS max_nt_per_aa, round(avg(n), 3) AS mean_nt_per_aa FROM c GROUP BY 1""")
def convergence(spark, d):
    return rounded(P.convergence(repertoire(spark, d), "sample", "nucleotide", "amino_acid"), "mean_nt_per_aa", digits=3)


@query("""SELECT source, round(avg(CASE WHEN length(text) > 0 THEN 100.0 * len(regexp_extract_all(text, '[GCSgcs]')) / length(text) END), 6) AS gc FROM documents GROUP BY 1""")
def gc_content(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(P.gc_percent("text")), 6).alias("gc"))


@query(f"WITH {REPERTOIRE} SELECT sample, v_gene AS gene, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share FROM rep GROUP BY sample, v_gene")
def gene_usage(spark, d):
    return rounded(P.usage(repertoire(spark, d), "sample", ["v_gene"]), "share")


@query(f"WITH {REPERTOIRE} SELECT sample, v_gene || '_' || j_gene AS gene, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share FROM rep GROUP BY sample, v_gene, j_gene")
def vj_usage(spark, d):
    return rounded(P.usage(repertoire(spark, d), "sample", ["v_gene", "j_gene"]), "share")


@query(f"WITH {REPERTOIRE} SELECT sample, round(100 * sum(frequency) FILTER (productive) / sum(frequency), 6) AS pct_weight, round(100 * avg(productive::INT), 6) AS pct_rows FROM rep GROUP BY 1")
def productive_percent(spark, d):
    return rounded(P.productive_percent(repertoire(spark, d), "sample", "frequency"), "pct_weight", "pct_rows")


@query(f"""WITH {SPECIES}, w AS (SELECT *, floor(abundance * 1000) AS w FROM species), q AS (SELECT sample, w / sum(w) OVER (PARTITION BY sample) AS p FROM w WHERE w > 0),
f AS (SELECT sample, -sum(p * log2(p)) AS shannon, 1 - sum(p * p) AS simpson, max(p) AS bp FROM q GROUP BY 1)
SELECT sample, count(*) AS n_components, round(avg(abundance), 6) AS mean_ra, round(max(abundance), 6) AS max_ra, round(max(abundance) / avg(abundance), 6) AS max_to_mean,
 round(any_value(shannon), 6) AS shannon, round(any_value(simpson), 6) AS simpson, round(any_value(bp), 6) AS berger_parker FROM species LEFT JOIN f USING (sample) WHERE abundance > 0 GROUP BY 1""")
def matrix_diversity(spark, d):
    return rounded(P.matrix_diversity(species(spark, d), "sample", "abundance", 1000), "mean_ra", "max_ra", "max_to_mean", "shannon", "simpson", "berger_parker")


@query(f"""WITH {REPERTOIRE}, c AS (SELECT sample, v_gene, count(*) AS n FROM rep GROUP BY ALL)
SELECT sample, v_gene AS commonest FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, v_gene) AS r FROM c) WHERE r = 1""")
def mode_gene(spark, d):
    return repertoire(spark, d).groupBy("sample").agg(F.mode("v_gene", True).alias("commonest"))


@query("""WITH m AS (SELECT 'balance' AS feature, c_acctbal AS value FROM customer UNION ALL SELECT 'nation', c_nationkey FROM customer UNION ALL SELECT 'flag', c_custkey % 2 FROM customer UNION ALL SELECT 'some', CASE WHEN c_custkey % 4 > 0 THEN 9999 END FROM customer),
c AS (SELECT feature, value, count(*) AS n FROM m GROUP BY ALL)
SELECT feature, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS n_null, coalesce(sum(n) FILTER (value = 9999), 0)::BIGINT AS n_sentinel, count(value) AS n_distinct, round(max(n) FILTER (value IS NOT NULL) / sum(n), 6) AS top_share,
 CASE WHEN count(value) <= 1 THEN 'constant' WHEN count(value) = 2 THEN 'binary' WHEN count(value) <= 5 THEN 'categorial' ELSE 'Continuous' END AS type FROM c GROUP BY 1""")
def feature_profile(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2).alias("flag"), F.when(F.col("c_custkey") % 4 > 0, 9999).alias("some"))
    return rounded(P.feature_profile(rows, ["balance", "nation", "flag", "some"]), "top_share")


@query(f"""WITH {REPERTOIRE}, b AS (SELECT productive, CASE WHEN cdr3_length < 1 THEN 0 WHEN cdr3_length >= 51 THEN 11 ELSE floor((cdr3_length - 1) / 5.0) + 1 END::BIGINT AS bin, sum(templates)::BIGINT AS weight FROM rep GROUP BY ALL)
SELECT *, (sum(weight) OVER (PARTITION BY productive ORDER BY bin))::BIGINT AS cumulative FROM b""")
def weighted_histogram(spark, d):
    return P.weighted_histogram(repertoire(spark, d), "productive", "cdr3_length", "templates", 1, 51, 10)


@query(f"""WITH {SHARES}, f AS (SELECT sample, -sum(p * log2(p)) AS shannon FROM clones GROUP BY 1), g AS (SELECT sample, avg(cdr3_length) AS len, avg(productive::INT) AS prod FROM rep GROUP BY 1),
u AS (SELECT sample, avg((j_gene = 'PROMO')::INT) AS j_promo, avg((j_gene = 'LARGE')::INT) AS j_large FROM rep GROUP BY 1)
SELECT sample, round(shannon, 6) AS shannon, round(len, 6) AS cdr3_length_mean, round(prod, 6) AS productive, round(j_promo, 6) AS "J_PROMO", round(j_large, 6) AS "J_LARGE" FROM f JOIN g USING (sample) JOIN u USING (sample)""")
def feature_matrix_wide(spark, d):
    rep = repertoire(spark, d)
    own = rep.groupBy("sample").agg(F.avg("cdr3_length").alias("cdr3_length_mean"), F.avg(F.col("productive").cast("int")).alias("productive"))
    usage = P.usage(rep, "sample", ["j_gene"]).groupBy("sample").pivot("gene", ["PROMO", "LARGE"]).agg(F.first("share")).na.fill(0.0)
    usage = usage.withColumnsRenamed({"PROMO": "J_PROMO", "LARGE": "J_LARGE"})
    out = P.diversity(rep, "sample", "nucleotide", "templates").select("sample", "shannon").join(own, "sample").join(usage, "sample")
    return rounded(out, *[c for c in out.columns if c != "sample"])


# Sharing


@query(f"WITH {SHARING} SELECT sequence, count(DISTINCT sample) AS n_shared, (count(DISTINCT sample) >= 2)::INT AS is_public FROM share GROUP BY 1")
def sharing_counts(spark, d):
    return P.sharing_counts(sharing(spark, d), "sequence", "sample")


@query(f"""WITH {SHARING}, c AS (SELECT sequence, count(*) AS n FROM share GROUP BY 1) SELECT sample, round(100 * avg((n >= 2)::INT), 6) AS pct_public, round(100 * avg((n > 5)::INT), 6) AS pct_over_5,
 round(100 * avg((n > 30)::INT), 6) AS pct_over_30, round(avg(n), 6) AS mean_shared FROM share JOIN c USING (sequence) GROUP BY 1""")
def public_rates(spark, d):
    return rounded(P.public_rates(sharing(spark, d), "sequence", "sample", [5, 30]), "pct_public", "pct_over_5", "pct_over_30", "mean_shared")


@query(f"WITH {SHARING}, c AS (SELECT sequence, count(*) AS n_shared FROM share GROUP BY 1) SELECT n_shared, count(*) AS n_sequences FROM c GROUP BY 1")
def sharing_histogram(spark, d):
    return P.sharing_counts(sharing(spark, d), "sequence", "sample").groupBy("n_shared").agg(F.count("*").alias("n_sequences"))


@query(f"""WITH {SHARING}, n AS (SELECT count(DISTINCT sample) AS n FROM share), k AS (SELECT sequence FROM share GROUP BY 1 HAVING count(*) >= ceil(0.3 * (SELECT n FROM n)) AND count(*) < ceil(0.45 * (SELECT n FROM n)))
SELECT sample, sequence, round(frequency, 4) AS frequency FROM share WHERE sequence IN (SELECT sequence FROM k)""")
def prevalence_filter(spark, d):
    cells = sharing(spark, d)
    n = cells.select("sample").distinct().count()
    return rounded(P.prevalent(cells, "sequence", n, 0.3, 0.45), "frequency", digits=4)


@query(f"""WITH {SHARING}, {COHORTS}, x AS (SELECT * FROM share JOIN cohorts USING (sample)), n AS (SELECT cohort, count(DISTINCT sample) AS n FROM x GROUP BY 1),
k AS (SELECT DISTINCT sequence FROM (SELECT cohort, sequence, count(*) AS c FROM x GROUP BY ALL) JOIN n USING (cohort) WHERE c >= ceil(0.4 * n) AND c < ceil(0.6 * n))
SELECT sample, sequence, cohort FROM x WHERE sequence IN (SELECT sequence FROM k)""")
def two_cohort_prevalence(spark, d):
    cells = sharing(spark, d).join(cohorts(spark, d), "sample")
    n = cells.groupBy("cohort").agg(F.count_distinct("sample").alias("n"))
    per = cells.groupBy("cohort", "sequence").agg(F.count("*").alias("c")).join(F.broadcast(n), "cohort")
    kept = per.where("c >= ceil(0.4 * n) and c < ceil(0.6 * n)").select("sequence").distinct()
    return cells.join(kept, "sequence", "left_semi").select("sample", "sequence", "cohort")


@query(f"""WITH {REPERTOIRE}, m AS (SELECT amino_acid, bit_or(CASE j_gene WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 4 END) AS mask FROM rep WHERE j_gene IN ('PROMO', 'LARGE', 'SMALL') GROUP BY 1)
SELECT (mask_ & 1 > 0)::INT || '' || (mask_ & 2 > 0)::INT || '' || (mask_ & 4 > 0)::INT AS region, count(mask) AS n FROM (SELECT unnest(range(1, 8)) AS mask_) LEFT JOIN m ON mask = mask_ GROUP BY mask_""")
def venn_regions(spark, d):
    return R.venn_regions(repertoire(spark, d), "amino_acid", "j_gene", ["PROMO", "LARGE", "SMALL"])


@query(f"""WITH {SHARING}, {COHORTS} SELECT sequence, count(*) AS n_shared FROM share JOIN cohorts USING (sample) GROUP BY 1 HAVING count(*) >= 2 AND min(cohort) = max(cohort)""")
def public_only_in(spark, d):
    rows = sharing(spark, d).join(cohorts(spark, d), "sample").groupBy("sequence").agg(F.count("*").alias("n_shared"), F.min("cohort").alias("a"), F.max("cohort").alias("b"))
    return rows.where("n_shared >= 2 and a = b").select("sequence", "n_shared")


@query(f"WITH {SHARING} SELECT a.sample AS sample1, b.sample AS sample2, count(*) AS n_shared FROM share a JOIN share b ON a.sequence = b.sequence AND a.sample < b.sample GROUP BY ALL")
def pair_shared_counts(spark, d):
    return P.shared_pairs(sharing(spark, d), "sample", "sequence")


@query(f"""WITH {REPERTOIRE}, a AS (SELECT sample, j_gene AS annotation, count(*) AS n, sum(frequency) AS f FROM rep WHERE j_gene IN ('PROMO', 'SMALL', 'LARGE') GROUP BY ALL)
SELECT sample, annotation, n, round(f, 4) AS frequency, round(n / sum(n) OVER w, 6) AS rel_n, round(f / sum(f) OVER w, 6) AS rel_frequency, (sum(n) OVER w)::BIGINT AS total FROM a WINDOW w AS (PARTITION BY sample)""")
def annotation_load(spark, d):
    rows = repertoire(spark, d).where(F.col("j_gene").isin("PROMO", "SMALL", "LARGE")).groupBy("sample", F.col("j_gene").alias("annotation")).agg(F.count("*").alias("n"), F.sum("frequency").alias("frequency"))
    own = Window.partitionBy("sample")
    out = rows.select("sample", "annotation", "n", "frequency", (F.col("n") / F.sum("n").over(own)).alias("rel_n"), (F.col("frequency") / F.sum("frequency").over(own)).alias("rel_frequency"), F.sum("n").over(own).alias("total"))
    return rounded(rounded(out, "rel_n", "rel_frequency"), "frequency", digits=4)


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n >= 80 THEN p_brand ELSE 'Other' END AS p_brand, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def rare_to_other(spark, d):
    return R.fold_rare(table(spark, d, "part"), "p_brand", 80)


@query(f"""WITH {REPERTOIRE} SELECT sample, nucleotide, sum(templates) FILTER (productive)::BIGINT AS rep1, sum(templates) FILTER (NOT productive)::BIGINT AS rep2,
 (count(*) FILTER (productive) > 0)::INT + (count(*) FILTER (NOT productive) > 0)::INT AS n_replicates FROM rep GROUP BY ALL""")
def replicate_overlap(spark, d):
    rows = repertoire(spark, d).groupBy("sample", "nucleotide").agg(
        F.sum(F.when(F.col("productive"), F.col("templates"))).alias("rep1"), F.sum(F.when(~F.col("productive"), F.col("templates"))).alias("rep2")
    )
    return rows.withColumn("n_replicates", F.col("rep1").isNotNull().cast("int") + F.col("rep2").isNotNull().cast("int"))


@query(f"""WITH {SHARING}, o AS (SELECT sample, row_number() OVER (ORDER BY md5('7:' || sample), sample) AS place FROM (SELECT DISTINCT sample FROM share)),
p AS (SELECT k, sequence, count(*) AS n FROM share JOIN o USING (sample) JOIN (VALUES (5), (20), (60)) v(k) ON place <= k GROUP BY ALL)
SELECT k, count(*) AS n_sequences, round(100 * avg((n >= 2)::INT), 6) AS pct_public, round(avg(n), 6) AS mean_shared, max(n) AS max_shared FROM p GROUP BY 1""")
def rarefaction_samples(spark, d):
    return rounded(P.sample_rarefaction(sharing(spark, d), "sample", "sequence", [5, 20, 60], 7), "pct_public", "mean_shared")


# Sampling


COUNTS = REPERTOIRE + ", counts AS (SELECT sample, nucleotide, sum(templates)::BIGINT AS n, (sum(sum(templates)) OVER (PARTITION BY sample))::BIGINT AS total FROM rep GROUP BY sample, nucleotide)"


def _counts(spark, d):
    return repertoire(spark, d).groupBy("sample", "nucleotide").agg(F.sum("templates").alias("n"))


@query(f"""WITH {COUNTS}, s AS (SELECT sample, n, total, count(*) AS k FROM counts GROUP BY ALL), e AS (SELECT *, unnest(range(2000, total + 1, 2000)) AS draw FROM s)
SELECT sample, draw, round(sum(k * (1 - CASE WHEN total - n >= draw THEN exp(lgamma(total - n + 1) - lgamma(total - n - draw + 1) - lgamma(total + 1) + lgamma(total - draw + 1)) ELSE 0 END)), 4) AS expected FROM e GROUP BY ALL""")
def rarefaction_expected(spark, d):
    return rounded(P.rarefaction_curve(_counts(spark, d), "sample", "n", 2000), "expected", digits=4)


@query(f"""WITH {COUNTS} SELECT sample, any_value(total) AS total, CASE WHEN any_value(total) >= 1000 THEN round(sum(1 - CASE WHEN total - n >= 1000 THEN exp(lgamma(total - n + 1) - lgamma(total - n - 1000 + 1) - lgamma(total + 1) + lgamma(total - 1000 + 1)) ELSE 0 END), 4) END AS expected
FROM counts GROUP BY 1""")
def normalized_richness(spark, d):
    return rounded(P.expected_richness(_counts(spark, d), "sample", "n", 1000), "expected", digits=4)


@query(f"""WITH {COUNTS}, x AS (SELECT sample, nucleotide, unnest(range(1, n + 1)) AS copy FROM counts),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5(concat_ws(':', '11', sample, nucleotide, copy)), nucleotide, copy) AS k, count(*) OVER (PARTITION BY sample) AS total FROM x)
SELECT sample, nucleotide, count(*) AS drawn FROM r WHERE k <= 500 AND total >= 500 GROUP BY ALL""")
def downsample_exact(spark, d):
    return P.downsample(_counts(spark, d), "sample", ["nucleotide"], "n", 500, 11)
