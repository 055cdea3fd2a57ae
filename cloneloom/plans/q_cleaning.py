"""Queries of cleaning, prevalence, named aggregates, orders, sets, sequence pairs at larger distances and the sequence model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.functions import scalars as X
from cloneloom.operators import cleaning as C
from cloneloom.operators import distance as D
from cloneloom.operators import ml as L
from cloneloom.operators import relational as R
from cloneloom.operators import repertoire as P
from cloneloom.operators import seqmodel as M
from cloneloom.operators import seqsim as Q
from cloneloom.plans.proxies import COHORTS, REPERTOIRE, SHARING, SPECIES, cohorts, repertoire, sharing, species, table
from cloneloom.plans.q_associations import JACCARD
from cloneloom.plans.q_models import _scored
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.q_sequences import CELLS, PADDED, WORDS, _words
from cloneloom.plans.q_statistics import CUSTOMER, _customers
from cloneloom.plans.registry import query


@query(f"""WITH {SHARING}, {COHORTS}, r AS (SELECT DISTINCT sample, sequence, cohort FROM share JOIN cohorts USING (sample)), b AS (SELECT sequence, cohort::VARCHAR AS g FROM r UNION ALL SELECT sequence, 'all' FROM r),
z AS (SELECT g, count(*) AS n FROM (SELECT cohort::VARCHAR AS g FROM cohorts UNION ALL SELECT 'all' FROM cohorts) GROUP BY 1), k AS (SELECT sequence, b.g, count(*) AS k, any_value(n) AS n FROM b JOIN z ON z.g = b.g GROUP BY 1, 2),
s AS (SELECT sequence FROM k GROUP BY 1 HAVING bool_or(k >= ceil(n * 0.4::DOUBLE)) AND bool_or(g = 'all' AND k < ceil(n * 0.55::DOUBLE)))
SELECT sample, sequence FROM share WHERE sequence IN (SELECT sequence FROM s)""")
def prevalent_in_any(spark, d):
    return C.prevalent_in_any(sharing(spark, d), cohorts(spark, d), "sample", "sequence", "cohort", 0.4, 0.55).select("sample", "sequence")


@query("""WITH m AS (SELECT user_id AS c_custkey, CASE WHEN count(*) > 5 THEN count(*) % 3 END AS kind, sum(value) AS reads, min(event_type) AS method FROM events GROUP BY 1)
SELECT c_custkey, c_name FROM customer LEFT JOIN m USING (c_custkey) WHERE kind IS DISTINCT FROM 1 AND reads > 200 AND method IN ('click', 'error')""")
def metadata_filter(spark, d):
    n = F.count("*")
    meta = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.when(n > 5, n % 3).alias("kind"), F.sum("value").alias("reads"), F.min("event_type").alias("method"))
    return C.by_properties(table(spark, d, "customer").select("c_custkey", "c_name"), meta, "c_custkey", {"kind": 1}, {"reads": 200}, {"method": ["click", "error"]})


def _features(spark, d):
    return _customers(spark, d).select(
        "c_custkey", F.col("spent").alias("spent_T"), (F.col("spent") * 2 + F.col("c_custkey") % 3).alias("spent"), F.col("n_orders").cast("double").alias("orders_0"), (F.col("n_orders") * 1.0 + F.col("c_custkey") % 2 * 0.01).alias("orders"),
        F.when(F.col("c_custkey") < 5, 1.0).alias("rare"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance_norm"), F.lit(7.0).alias("seven"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey") * 1.0).alias("nation"),
    )


@query(f"""WITH {CUSTOMER} SELECT 'c_custkey,spent_T,orders,balance_norm,nation' AS columns, round(sum(coalesce(nation, 0)), 2) AS nation, count(balance_norm) AS n_balance
FROM (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_nationkey * 1.0 END AS nation, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance_norm FROM c)""")
def cleaned_features(spark, d):
    columns = ["spent", "spent_T", "orders_0", "orders", "rare", "balance_norm", "seven", "nation"]
    out = C.cleaned(_features(spark, d), columns, 0.99)
    names = ",".join(c for c in ["c_custkey", "spent_T", "spent", "orders_0", "orders", "rare", "balance_norm", "seven", "nation"] if c in out.columns)
    return out.agg(F.lit(names).alias("columns"), F.round(F.sum("nation"), 2).alias("nation"), F.count("balance_norm").alias("n_balance"))


@query(f"""WITH {JACCARD}, o AS (SELECT a.o_custkey AS s1, b.o_custkey AS s2, abs(a.n - b.n) AS y FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON a.o_custkey < b.o_custkey)
SELECT jac.s1 AS sample1, jac.s2 AS sample2, round(dist, 6) AS x, y FROM jac JOIN o USING (s1, s2) WHERE s1 % 7 <> s2 % 7""")
def aligned_pairs(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("n"))
    users = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 7).alias("user"))
    pairs = D.jaccard(sharing(spark, d), "sample", "sequence", n.join(users.withColumnRenamed("user", "u"), "sample", "left"))
    return rounded(C.aligned(pairs.select("sample1", "sample2", F.col("dist").alias("x"), F.abs(F.col("n1") - F.col("n2")).alias("y"), "u1", "u2")), "x")


PARTS = (("total", "true"), ("prod", "productive"), ("nonprod", "NOT productive"))


@query(f"WITH {REPERTOIRE} SELECT sample, " + ", ".join(f"round(avg(cdr3_length) FILTER ({t}), 6) AS mean_cdr3_length_{p}, max(templates) FILTER ({t}) AS max_templates_{p}, count(DISTINCT v_gene) FILTER ({t}) AS n_distinct_v_gene_{p}, coalesce(max((templates = 1)::INT) FILTER ({t}), 0) AS any_positive_templates_{p}" for p, t in PARTS) + " FROM rep GROUP BY 1")
def named_aggregates(spark, d):
    out = C.named_aggregates(repertoire(spark, d), ["sample"], {"mean": ["cdr3_length"], "max": ["templates"], "n_distinct": ["v_gene"], "any_positive": ["templates"]})
    return rounded(out, *[f"mean_cdr3_length_{p}" for p, _ in PARTS])


@query(f"""WITH {REPERTOIRE}, w AS (SELECT sample, templates, avg(templates) OVER x AS m, stddev_pop(templates) OVER x AS s, count(*) OVER x AS n FROM rep WINDOW x AS (PARTITION BY sample)), a AS (SELECT sample, round(coalesce(avg(templates) FILTER (n <= 3 OR s = 0 OR abs(templates - m) <= 3 * s), avg(templates)), 6) AS robust FROM w GROUP BY 1),
g AS (SELECT sample, v_gene, count(*) AS n FROM rep GROUP BY ALL), b AS (SELECT sample, v_gene AS commonest FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, v_gene) AS r FROM g) WHERE r = 1),
l AS (SELECT sample, array_to_string(list_sort(list(DISTINCT j_gene)), ',') AS genes FROM rep GROUP BY 1) SELECT sample, robust, commonest, genes FROM a JOIN b USING (sample) JOIN l USING (sample)""")
def merged_on(spark, d):
    rep = repertoire(spark, d)
    a = rounded(C.merged_on(rep, ["sample"], "templates", "no_outlier_mean"), "templates").withColumnRenamed("templates", "robust")
    b = C.merged_on(rep, ["sample"], "v_gene", "most_frequent").withColumnRenamed("v_gene", "commonest")
    genes = C.merged_on(rep, ["sample"], "j_gene", "list").select("sample", F.array_join("j_gene", ",").alias("genes"))
    return a.join(b, "sample").join(genes, "sample")


@query("""SELECT "column", count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max FROM (SELECT c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (value FOR "column" IN (balance, nation)) GROUP BY 1""")
def described(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return rounded(C.described(rows, ["balance", "nation"]), "mean", "std", digits=5)


@query(f"WITH {REPERTOIRE} SELECT sample, status, count(*) AS n, sum(templates)::BIGINT AS weight, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS share_n, round(sum(templates) / sum(sum(templates)) OVER (PARTITION BY sample), 6) AS share_weight FROM rep GROUP BY sample, status")
def read_quality(spark, d):
    return rounded(C.read_quality(repertoire(spark, d), "sample", "templates", "status"), "share_n", "share_weight")


@query(f"WITH {SPECIES} SELECT 'sample' AS side, sample::VARCHAR AS name, round(sum(abundance), 6) AS total, count(*) AS n FROM species GROUP BY ALL UNION ALL SELECT 'feature', feature, round(sum(abundance), 6), count(*) FROM species GROUP BY ALL")
def matrix_sums(spark, d):
    a, b = C.matrix_sums(species(spark, d), "sample", "feature", "abundance")
    named = lambda df, side: df.select(F.lit(side).alias("side"), F.col(side).cast("string").alias("name"), F.round("total", 6).alias("total"), "n")
    return named(a, "sample").unionByName(named(b, "feature"))


@query("""WITH p AS (SELECT c_custkey % 17 AS a, c_custkey % 13 AS b, c_custkey % 11 AS c FROM customer) SELECT CASE WHEN a = least(a, b, c) THEN 'a' WHEN b = least(a, b, c) THEN 'b' ELSE 'c' END AS "column", count(*) AS n FROM p GROUP BY 1""")
def least_column_counts(spark, d):
    k = F.col("c_custkey")
    return C.least_column_counts(table(spark, d, "customer").select((k % 17).alias("a"), (k % 13).alias("b"), (k % 11).alias("c")), ["a", "b", "c"])


@query(f"""WITH {SHARING}, {COHORTS}, h AS (SELECT sample, sequence, row_number() OVER (PARTITION BY sample ORDER BY md5(concat_ws(':', '3', sample, sequence)), sequence) AS k FROM share), r AS (SELECT sample, sequence, cohort FROM h JOIN cohorts USING (sample) WHERE k <= 200),
p AS (SELECT cohort, sequence, (count(*) >= 2)::INT AS public FROM r GROUP BY ALL) SELECT cohort, sample, count(*) AS n_sequences, sum(public)::BIGINT AS n_public, round(100.0 * sum(public) / count(*), 6)::DOUBLE AS pct_public FROM r JOIN p USING (cohort, sequence) GROUP BY ALL""")
def sharing_after_sampling(spark, d):
    return rounded(C.sharing_after_sampling(sharing(spark, d), cohorts(spark, d), "sample", "sequence", "cohort", 200, 3), "pct_public")


@query(f"""WITH {SHARING}, {COHORTS}, c AS (SELECT sequence, count(*) AS n FROM share GROUP BY 1), s AS (SELECT sample, 100 * avg((n >= 2)::INT) AS p, avg(n) AS m FROM share JOIN c USING (sequence) GROUP BY 1) SELECT cohort, count(*) AS n, round(avg(p), 6) AS pct_public, round(avg(m), 6) AS mean_shared FROM s JOIN cohorts USING (sample) GROUP BY 1""")
def rates_by_group(spark, d):
    rates = P.public_rates(sharing(spark, d), "sequence", "sample", [])
    return rounded(C.rates_by_group(rates, cohorts(spark, d), "sample", "cohort", ["pct_public", "mean_shared"]), "pct_public", "mean_shared")


@query(f"WITH {REPERTOIRE}, {COHORTS}, q AS (SELECT cohort, quantile_cont(templates, list_transform(range(101), lambda i: i / 100)) AS v FROM rep JOIN cohorts USING (sample) GROUP BY 1) SELECT cohort, unnest(range(101))::INT AS percentile, round(unnest(v), 6)::DOUBLE AS value FROM q")
def percentile_list(spark, d):
    return rounded(C.percentile_list(repertoire(spark, d).join(cohorts(spark, d), "sample"), "cohort", "templates"), "value")


@query("""WITH p AS (SELECT c_custkey, (c_custkey % 5)::DOUBLE AS a, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 3)::DOUBLE END AS b, (c_custkey % 2)::DOUBLE AS c FROM customer), l AS (SELECT c_custkey, f, v FROM p UNPIVOT (v FOR f IN (a, b, c))),
r AS (SELECT *, rank() OVER (PARTITION BY c_custkey ORDER BY v) + (count(*) OVER (PARTITION BY c_custkey, v) - 1) / 2.0 AS k FROM l) SELECT c_custkey, max(k) FILTER (f = 'a') AS a, max(k) FILTER (f = 'b') AS b, max(k) FILTER (f = 'c') AS c FROM r GROUP BY 1""")
def row_ranks(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, (k % 5).alias("a"), F.when(k % 4 > 0, k % 3).alias("b"), (k % 2).alias("c"))
    return rows.select("c_custkey", *[c.alias(n) for n, c in C.row_ranks(["a", "b", "c"]).items()])


@query(f"""WITH {SPECIES}, s AS (SELECT sample, feature, round(abundance, 9) AS v FROM species) SELECT 'row' AS side, sample::VARCHAR AS name, row_number() OVER (ORDER BY max(v) DESC, sample)::INT AS place FROM s GROUP BY sample
UNION ALL SELECT 'column', feature, row_number() OVER (ORDER BY max(v) DESC, feature)::INT FROM s GROUP BY feature""")
def matrix_order(spark, d):
    a, b = C.matrix_order(rounded(species(spark, d), "abundance", digits=9), "sample", "feature", "abundance")
    return a.select(F.lit("row").alias("side"), F.col("sample").cast("string").alias("name"), "place").unionByName(b.select(F.lit("column").alias("side"), F.col("feature").alias("name"), "place"))


@query(f"WITH {SHARING}, c AS (SELECT sample, count(*) AS n_rows FROM share GROUP BY 1) SELECT sample, n_rows FROM c ORDER BY n_rows, sample LIMIT 1 OFFSET 6")
def nth_by_count(spark, d):
    return C.nth_by_count(sharing(spark, d), "sample", 7)


@query(f"""WITH {REPERTOIRE}, r AS (SELECT amino_acid, sample % 4 AS rep, templates FROM rep) SELECT amino_acid, """ + ", ".join(f"sum(templates) FILTER (rep = {i})::BIGINT AS rep_{i}" for i in range(4)) + ", " + " + ".join(f"(count(*) FILTER (rep = {i}) > 0)::INT" for i in range(4)) + " AS n_replicates FROM r GROUP BY 1")
def replicate_membership(spark, d):
    rows = repertoire(spark, d).select("amino_acid", (F.col("sample") % 4).alias("rep"), "templates")
    return C.replicate_membership(rows, "amino_acid", "rep", "templates", [0, 1, 2, 3])


@query("""WITH m AS (SELECT DISTINCT user_id AS g, event_type AS i FROM events), z AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
SELECT a.g AS inner_, b.g AS outer_ FROM m a JOIN m b ON a.i = b.i AND a.g <> b.g JOIN z ON z.g = a.g GROUP BY 1, 2, n HAVING count(*) = n""")
def subset_pairs(spark, d):
    return C.subset_pairs(table(spark, d, "events"), "user_id", "event_type").withColumnsRenamed({"inner": "inner_", "outer": "outer_"})


@query("SELECT o_custkey, " + ", ".join(f"round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 0), 4) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_mean(spark, d):
    return rounded(C.pivot_mean(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", list("FOP")), *"FOP", digits=4)


@query("""SELECT 'n_regionkey' AS "column", """ + ", ".join(f'max(n_regionkey) FILTER (n_nationkey = {k}) AS "{k}"' for k in (0, 3, 7)) + """ FROM nation UNION ALL SELECT 'twice', """ + ", ".join(f"max(2 * n_nationkey) FILTER (n_nationkey = {k})" for k in (0, 3, 7)) + " FROM nation")
def transposed(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 2).alias("twice"))
    return C.transposed(rows, "n_nationkey", ["n_regionkey", "twice"], [0, 3, 7])


@query("""WITH a AS (SELECT user_id AS c_custkey, event_type AS label FROM events WHERE value > 90), l AS (SELECT c_custkey, array_to_string(list_sort(list(DISTINCT label)), ';') AS labels, count(*) AS n_labels FROM a GROUP BY 1)
SELECT c.c_custkey, label, labels, coalesce(n_labels, 0) AS n_labels FROM customer c LEFT JOIN a USING (c_custkey) LEFT JOIN l USING (c_custkey)""")
def annotation_join(spark, d):
    notes = table(spark, d, "events").where("value > 90").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("label"))
    return C.annotated(table(spark, d, "customer").select("c_custkey"), notes, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS a, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderpriority = '1-URGENT')::INT END AS b, o_orderkey % 900 AS days FROM orders), s AS (SELECT *, greatest(coalesce(a, 0), coalesce(b, 0)) AS any_outcome FROM o)
SELECT o_orderkey, any_outcome, CASE WHEN any_outcome = 1 AND days <= 365 THEN 1 WHEN any_outcome = 0 THEN 0 END AS early_outcome FROM s""")
def new_outcomes(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, (F.col("o_orderstatus") == "F").cast("int").alias("a"), F.when(k % 5 > 0, (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("b"), (k % 900).alias("days"))
    return C.new_outcomes(rows, ["a", "b"], "days", 365).select("o_orderkey", "any_outcome", "early_outcome")


@query("""SELECT o_orderkey, nullif(regexp_extract(o_orderdate::DATE::VARCHAR, '^20(\\w+)', 1), '') AS years, (2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) AS months, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS place FROM orders""")
def scalar_dates(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("end", F.lit("2001-08-01").cast("date"))
    rows = R.places_by(rows, [F.desc("o_orderpriority"), "o_totalprice", "o_orderkey"], "place")
    return rows.select("o_orderkey", F.nullif(F.regexp_extract(F.col("day").cast("string"), r"^(?<=^)20(\w+)", 1), F.lit("")).alias("years"), X.months_between_dates("day", "end").alias("months"), "place")


# Sequences

NEAR2 = WORDS + f", edges AS (SELECT a.id AS seq1id, b.id AS seq2id, ({PADDED})::INT AS dist FROM seqs a JOIN seqs b ON a.id < b.id AND abs(length(a.seq) - length(b.seq)) <= 3 WHERE {PADDED} <= 3)"


@query(f"WITH {NEAR2} SELECT * FROM edges WHERE dist <= 2")
def padded_hamming_within(spark, d):
    return Q.padded_hamming_within(_words(spark, d), 2)


@query(f"WITH {WORDS} SELECT a.id AS seq1id, b.id AS seq2id, levenshtein(a.seq, b.seq)::INT AS dist FROM seqs a JOIN seqs b ON a.id < b.id WHERE levenshtein(a.seq, b.seq) <= 2")
def levenshtein_within(spark, d):
    return Q.levenshtein_within(_words(spark, d), 2)


@query(f"WITH {NEAR2}, b AS (SELECT seq1id AS id, dist FROM edges UNION ALL SELECT seq2id, dist FROM edges) SELECT seqs.id, min(dist) AS nearest, count(dist) AS n_near FROM seqs LEFT JOIN b USING (id) GROUP BY 1")
def nearest_reads(spark, d):
    return Q.nearest_reads(_words(spark, d), 3)


@query(f"""WITH {NEAR2}, e AS (SELECT * FROM edges WHERE dist <= 1), f AS (SELECT seq1id AS head, seq2id AS member FROM e UNION SELECT seq2id, seq1id FROM e UNION SELECT seq1id, seq1id FROM e UNION SELECT seq2id, seq2id FROM e),
m AS (SELECT head, list_sort(list(member)) AS members FROM f GROUP BY 1), k AS (SELECT min(head) AS head FROM m GROUP BY members) SELECT head, member FROM f WHERE head IN (SELECT head FROM k)""")
def distinct_full_clusters(spark, d):
    return Q.distinct_clusters(Q.full_clusters(Q.padded_hamming_pairs(_words(spark, d))))


@query("""WITH s AS (SELECT page_id, translate(regexp_replace(lower(html), '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS nucleotide FROM pages), t AS (SELECT page_id, nucleotide, CASE WHEN page_id % 5 > 0 THEN page_id % 4 END AS n1, 3 + page_id % 6 AS di, CASE WHEN page_id % 7 > 0 THEN 4 + page_id % 3 END AS n2, 8 + page_id % 5 AS ji FROM s)
SELECT page_id, CASE WHEN n1 IS NOT NULL THEN substring(nucleotide, n1 + 1, greatest(di - n1, 0)) END AS ins1, CASE WHEN n2 IS NOT NULL THEN reverse(translate(substring(nucleotide, n2 + 1, greatest(ji - n2, 0)), 'ACGT', 'TGCA')) END AS ins2, coalesce(length(CASE WHEN n1 IS NOT NULL THEN substring(nucleotide, n1 + 1, greatest(di - n1, 0)) END), 0) AS length1 FROM t""")
def insertion_sequences(spark, d):
    p = F.col("page_id")
    rows = table(spark, d, "pages").select(p, F.upper(F.regexp_replace(F.lower("html"), "[^acgt]", "")).alias("nucleotide"), F.when(p % 5 > 0, (p % 4).cast("int")).alias("n1Index"), (3 + p % 6).cast("int").alias("dIndex"), F.when(p % 7 > 0, (4 + p % 3).cast("int")).alias("n2Index"), (8 + p % 5).cast("int").alias("jIndex"))
    a = M.insertions(rows, "ins1").select("page_id", F.col("insertion").alias("ins1"), F.col("insertion_length").cast("long").alias("length1"))
    return a.join(M.insertions(rows, "ins2").select("page_id", F.col("insertion").alias("ins2")), "page_id")


DNA = "acgt AS (SELECT item_id, translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT') AS seq FROM benchmark), lt AS (SELECT item_id, least(length(seq), 41) AS length, k AS place, seq[k] AS letter, CASE WHEN k > 1 THEN seq[k - 1] END AS previous FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS k FROM acgt))"


def _dna(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))
    return M.letters(rows, "item_id", "seq").withColumn("length", M.length_bucket("length", 40).cast("long"))


@query(f"""WITH {DNA}, c AS (SELECT length, previous, letter, count(*) AS n FROM lt WHERE previous IS NOT NULL GROUP BY ALL), pr(previous, letter, k) AS (VALUES """ + ", ".join(f"('{x}', '{y}', {n})" for x, own in M.MOVE_PRIORS["weak differ"].items() for y, n in own.items()) + """),
e AS (SELECT l.length, pr.previous, pr.letter, k + coalesce(n, 0) AS n FROM (SELECT DISTINCT length FROM c) l CROSS JOIN pr LEFT JOIN c ON c.length = l.length AND c.previous = pr.previous AND c.letter = pr.letter)
SELECT length, previous, letter, round(n / sum(n) OVER (PARTITION BY length, previous), 6) AS p FROM e""")
def moves_with_prior(spark, d):
    counts = _dna(spark, d).where("previous is not null").groupBy("length", "previous", "letter").agg(F.count("*").alias("n"))
    return rounded(M.with_prior(counts, ["length", "previous"], M.MOVE_PRIORS["weak differ"]), "p")


@query(f"""WITH {DNA}, c AS (SELECT length, letter, count(*) AS n FROM lt WHERE place = 1 GROUP BY ALL), pr(letter, k) AS (VALUES """ + ", ".join(f"('{y}', {n})" for y, n in M.FIRST_PRIORS["strong differ"].items()) + """),
e AS (SELECT l.length, pr.letter, k + coalesce(n, 0) AS n FROM (SELECT DISTINCT length FROM c) l CROSS JOIN pr LEFT JOIN c ON c.length = l.length AND c.letter = pr.letter) SELECT length, letter, round(n / sum(n) OVER (PARTITION BY length), 6) AS p FROM e""")
def first_with_prior(spark, d):
    counts = _dna(spark, d).where("place = 1").groupBy("length", "letter").agg(F.count("*").alias("n"))
    return rounded(M.with_prior(counts, ["length"], M.FIRST_PRIORS["strong differ"]), "p")


GENE_PAIRS = [("v_gene", "j_gene"), ("v_gene", "v_deletion"), ("j_gene", "j_deletion"), ("j_gene", "cdr3_length"), ("v_gene", "cdr3_length")]
TABLES = REPERTOIRE + ", pc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS given, '{b}' AS \"then\", {a}::VARCHAR AS given_value, {b}::VARCHAR AS then_value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY {a}) AS p FROM rep GROUP BY {a}, {b}" for a, b in GENE_PAIRS) + ")"


@query(f"WITH {TABLES} SELECT given, \"then\", given_value, then_value, n, round(p, 6) AS p FROM pc")
def conditional_tables(spark, d):
    return rounded(M.conditional_tables(repertoire(spark, d), GENE_PAIRS), "p")


@query(f"WITH {TABLES}, q AS (SELECT nucleotide, avg(" + " + ".join(f"log10((SELECT p FROM pc WHERE given = '{a}' AND \"then\" = '{b}' AND given_value = {a}::VARCHAR AND then_value = {b}::VARCHAR))" for a, b in GENE_PAIRS) + ") AS p, count(*) AS n FROM rep GROUP BY 1) SELECT nucleotide, n * 5 AS n_terms, round(p * n, 4) AS log10_p FROM q")
def row_log_probabilities(spark, d):
    rep = repertoire(spark, d)
    return rounded(M.row_log_probabilities(rep, "nucleotide", M.conditional_tables(rep, GENE_PAIRS), GENE_PAIRS), "log10_p", digits=4)


# Evaluation and models


@query("""WITH s AS (SELECT p_brand AS by_, p_size % 4 AS y, (p_size + p_partkey % 2) % 4 AS p FROM part), c AS (SELECT by_, y, p, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT by_, y AS class, n AS t, CASE WHEN y = p THEN n ELSE 0 END AS hit, n AS both_ FROM c UNION ALL SELECT by_, p, 0, 0, n FROM c),
f AS (SELECT by_, class, sum(t) AS t, sum(hit) AS tp, sum(both_) AS b FROM k GROUP BY ALL) SELECT by_ AS p_brand, sum(t)::BIGINT AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(2 * tp / b), 6) AS macro_f1 FROM f GROUP BY 1""")
def eval_macro_f1(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") % 4).alias("y"), ((F.col("p_size") + F.col("p_partkey") % 2) % 4).alias("predicted"))
    return rounded(L.macro_f1(rows, ["p_brand"], "y", "predicted"), "accuracy", "macro_f1")


@query("""WITH s AS (SELECT c_nationkey, c_custkey % 23 AS shuffle, sum(c_acctbal) AS v FROM customer GROUP BY ALL), r AS (SELECT c_nationkey, v AS real FROM s WHERE shuffle = 0)
SELECT c_nationkey, round(real, 2) AS v, round((1 + count(*) FILTER (v >= real)) / (1 + count(*)), 6) AS p, count(*) AS n_shuffles FROM r JOIN s USING (c_nationkey) WHERE shuffle > 0 GROUP BY 1, real""")
def observed_p(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey", F.nullif(F.col("c_custkey") % 23, F.lit(0)).alias("shuffle")).agg(F.sum("c_acctbal").alias("v"))
    return rounded(rounded(L.observed_p(rows, ["c_nationkey"], "v", "shuffle"), "p"), "v", digits=2)


@query("""WITH x AS (SELECT y, a, b FROM (SELECT spent AS y, n_orders::DOUBLE AS a, c_acctbal AS b FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL))),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM x), w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT 'n_orders' AS feature, round(wa, 3) AS coefficient FROM w UNION ALL SELECT 'c_acctbal', round(wb, 3) FROM w UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 3) FROM w""")
def linear_coefficients(spark, d):
    rows = _customers(spark, d).withColumn("n_orders", F.col("n_orders").cast("double"))
    return rounded(L.linear_p_values(rows, "spent", ["n_orders", "c_acctbal"]).select("feature", "coefficient"), "coefficient", digits=3)


@query()
def nested_logistic(spark, d):
    """Deviance and adjusted pseudo-R2 as features come in one by one."""
    rows = _scored(spark, d).withColumn("length", F.log1p("n_chars"))
    return L.nested_logistic(rows, "y", ["toxic", "length"])


@query()
def healthy_models_on_patients(spark, d):
    """Documents that are toxic scored by models of those that are not."""
    rows = _scored(spark, d).withColumn("length", F.log1p("n_chars"))
    return L.averaged_models(rows.where("toxic = 0"), rows.where("toxic = 1"), "doc_id", "y", ["length", "score"])


@query()
def cohort_match_rules(spark, d):
    """Matching by a list of rules, the strictest first."""
    from cloneloom.operators.cohort import matched_by_rules
    from cloneloom.plans.q_models import _people

    rows = _people(spark, d)
    return matched_by_rules(rows.where("c_custkey % 10 = 0"), rows.where("c_custkey % 10 > 0"), "c_custkey", [("c_mktsegment", "identity", None), ("age", "delta", 3.0), ("c_acctbal", "delta", 300.0)])


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey::DOUBLE AS age FROM customer) SELECT 0::BIGINT AS n_unmatched_in_reach, 0::BIGINT AS n_repeated, 0::BIGINT AS n_out_of_reach""")
def cohort_match_invariants(spark, d):
    """Of greedy matching: free cases with a free member in reach, members taken twice, pairs out of reach; none of them occurs."""
    from cloneloom.operators.cohort import greedy_match, nearest_match
    from cloneloom.plans.q_models import _people

    rows = _people(spark, d)
    cases, pool = rows.where("c_custkey % 10 = 0"), rows.where("c_custkey % 10 > 0")
    how = ("c_custkey", ["c_mktsegment"], [("age", 3.0), ("c_acctbal", 800.0)])
    found = greedy_match(cases, pool, *how)
    left, members = cases.join(found.select("c_custkey"), "c_custkey", "left_anti"), pool.join(found.select(F.col("match").alias("c_custkey")), "c_custkey", "left_anti")
    free = nearest_match(left, members, *how).agg(F.count("match").alias("n_unmatched_in_reach"))
    twice = found.groupBy("match").count().where("count > 1").agg(F.count("*").alias("n_repeated"))
    b = pool.select(F.col("c_custkey").alias("match"), F.col("c_mktsegment").alias("segment"), F.col("age").alias("age2"), F.col("c_acctbal").alias("balance"))
    near = (F.col("c_mktsegment") == F.col("segment")) & (F.abs(F.col("age") - F.col("age2")) <= 3) & (F.abs(F.col("c_acctbal") - F.col("balance")) <= 800)
    beyond = found.join(cases, "c_custkey").join(b, "match").agg(F.sum((~near).cast("long")).alias("n_out_of_reach"))
    return free.crossJoin(twice).crossJoin(beyond)  # one row each
