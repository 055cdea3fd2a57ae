"""Queries of sequence similarity, sequence search and the sequence model."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloneloom.functions import scalars as X
from cloneloom.operators import seqmodel as M
from cloneloom.operators import seqsim as Q
from cloneloom.plans.proxies import table
from cloneloom.plans.q_repertoire import rounded
from cloneloom.plans.registry import query

#: Different words of 4 and more small letters stand for sequences.
WORDS = """words AS (SELECT DISTINCT seq FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS seq FROM benchmark) WHERE length(seq) >= 4),
seqs AS (SELECT row_number() OVER (ORDER BY md5(seq), seq) AS id, seq FROM words)"""
PADDED = "list_sum(list_transform(range(1, least(length(a.seq), length(b.seq)) + 1), lambda i: (a.seq[i] <> b.seq[i])::INT)) + abs(length(a.seq) - length(b.seq))"
EDGES = WORDS + f", edges AS (SELECT a.id AS seq1id, b.id AS seq2id, ({PADDED})::INT AS dist FROM seqs a JOIN seqs b ON a.id < b.id AND abs(length(a.seq) - length(b.seq)) <= 1 WHERE {PADDED} <= 1)"
CLUSTERS = EDGES + ", clusters AS (SELECT seq1id AS head, seq2id AS member FROM edges UNION SELECT seq1id, seq1id FROM edges)"


def _words(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("seq")
    return Q.with_ids(table(spark, d, "benchmark").select(found), "seq")


@query(f"WITH {EDGES} SELECT * FROM edges")
def padded_hamming_pairs(spark, d):
    return Q.padded_hamming_pairs(_words(spark, d))


@query(f"WITH {WORDS} SELECT a.id AS seq1id, b.id AS seq2id, levenshtein(a.seq, b.seq)::INT AS dist FROM seqs a JOIN seqs b ON a.id < b.id WHERE levenshtein(a.seq, b.seq) <= 1")
def levenshtein_pairs(spark, d):
    return Q.levenshtein_pairs(_words(spark, d))


@query(f"WITH {CLUSTERS} SELECT head, count(*) AS size, min(member) AS low, max(member) AS high FROM clusters GROUP BY 1")
def head_clusters(spark, d):
    return Q.head_clusters(Q.padded_hamming_pairs(_words(spark, d))).groupBy("head").agg(F.count("*").alias("size"), F.min("member").alias("low"), F.max("member").alias("high"))


@query(f"""WITH {CLUSTERS}, z AS (SELECT head, list(member) AS ms FROM clusters GROUP BY 1)
SELECT head, member FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM z a, z b WHERE a.head = c.head AND b.head <> a.head AND len(b.ms) > len(a.ms) AND list_contains(b.ms, a.head) AND list_has_all(b.ms, a.ms))""")
def drop_contained_clusters(spark, d):
    return Q.drop_contained_clusters(Q.head_clusters(Q.padded_hamming_pairs(_words(spark, d)))).select("head", "member")


def _cells(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("sample"), F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("seq")).distinct()
    return words.join(_words(spark, d), "seq")


CELLS = ", cells AS (SELECT DISTINCT item_id AS sample, unnest(regexp_extract_all(text, '[a-z]+')) AS seq FROM benchmark)"


@query(f"WITH {CLUSTERS}{CELLS} SELECT sample, head, count(*) AS n FROM cells JOIN seqs USING (seq) JOIN clusters ON member = id GROUP BY ALL")
def sample_by_cluster(spark, d):
    return Q.sample_by_cluster(_cells(spark, d), Q.head_clusters(Q.padded_hamming_pairs(_words(spark, d))), "sample", "id")


@query(f"""WITH {CLUSTERS}, n AS (SELECT head, seq[1] AS label, count(*) AS n FROM clusters JOIN seqs ON member = id GROUP BY ALL)
SELECT head, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) AS summary FROM n GROUP BY 1""")
def cluster_annotations(spark, d):
    words = _words(spark, d)
    labels = words.select(F.col("id").alias("member"), F.substring("seq", 1, 1).alias("label"))
    return Q.cluster_annotations(Q.head_clusters(Q.padded_hamming_pairs(words)), labels)


@query("""WITH p AS (SELECT DISTINCT substring(text, 11, 12) AS pattern FROM benchmark WHERE length(text) >= 22),
c AS (SELECT doc_id, s, substring(text, s + 1, 523) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text), 512)) AS s FROM documents))
SELECT doc_id, pattern, s + k - 1 AS offset FROM (SELECT doc_id, s, t, unnest(range(1, least(512, length(t) - 11) + 1)) AS k FROM c) JOIN p ON substring(t, k, 12) = pattern""")
def exact_match_offsets(spark, d):
    patterns = table(spark, d, "benchmark").where("length(text) >= 22").select(F.substring("text", 11, 12).alias("pattern")).distinct()
    texts = table(spark, d, "documents").select("doc_id", "text")
    return Q.exact_matches(texts, "doc_id", "text", patterns, "pattern", 8).withColumn("offset", F.col("offset").cast("long"))


@query("SELECT kmer, count(*) AS n, count(DISTINCT item_id) AS n_items FROM (SELECT item_id, unnest(list_transform(range(1, length(text) - 3), lambda i: substring(text, i, 5))) AS kmer FROM benchmark) GROUP BY 1")
def kmer_index(spark, d):
    return Q.kmers(table(spark, d, "benchmark"), "item_id", "text", 5).groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


@query("""WITH p AS (SELECT DISTINCT substring(text, 11, 10) AS pattern FROM benchmark WHERE length(text) >= 20),
t AS (SELECT item_id, text, unnest(range(1, length(text) - 8)) AS k FROM benchmark),
m AS (SELECT item_id, pattern, k - 1 AS offset, list_sum(list_transform(range(1, 11), lambda i: (substring(text, k + i - 1, 1) <> pattern[i])::INT))::INT AS n_mismatches FROM t, p)
SELECT * FROM m WHERE n_mismatches <= 2""")
def approx_match(spark, d):
    items = table(spark, d, "benchmark")
    patterns = items.where("length(text) >= 20").select(F.substring("text", 11, 10).alias("pattern")).distinct()
    return Q.approximate_matches(items, "item_id", "text", patterns, "pattern", 10, 2).withColumn("offset", F.col("offset").cast("long"))


@query("""WITH p AS (SELECT DISTINCT substring(text, 11, 12) AS pattern FROM benchmark WHERE length(text) >= 22), t AS (SELECT item_id, text, unnest(range(1, length(text) - 10)) AS k FROM benchmark),
m AS (SELECT item_id, pattern, k - 1 AS offset, list_sum(list_transform(range(1, 13), lambda i: (substring(text, k + i - 1, 1) <> pattern[i])::INT))::INT AS n_mismatches FROM t, p)
SELECT * FROM m WHERE n_mismatches <= 3""")
def spaced_match(spark, d):
    items = table(spark, d, "benchmark")
    patterns = items.where("length(text) >= 22").select(F.substring("text", 11, 12).alias("pattern")).distinct()
    return Q.spaced_matches(items, "item_id", "text", patterns, "pattern", 12, 3, 4).withColumn("offset", F.col("offset").cast("long"))


LETTERS = WORDS + ", l AS (SELECT id, length(seq) AS length, k AS place, seq[k] AS letter, CASE WHEN k > 1 THEN seq[k - 1] END AS previous FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS k FROM seqs))"


@query(f"""WITH {LETTERS}, c AS (SELECT length, previous, letter, count(*) AS n FROM l WHERE previous IS NOT NULL GROUP BY ALL)
SELECT length, previous, letter, round((n + 0.5) / (sum(n) OVER (PARTITION BY length, previous) + 13), 6)::DOUBLE AS p FROM c""")
def dinucleotide_probs(spark, d):
    rows = M.letters(_words(spark, d), "id", "seq").withColumn("length", F.col("length").cast("long"))
    return rounded(M.transition_probs(rows, 0.5, 26), "p")


@query(f"""WITH {LETTERS}, f AS (SELECT length, letter, count(*) / sum(count(*)) OVER (PARTITION BY length) AS p FROM l WHERE place = 1 GROUP BY length, letter),
m AS (SELECT length, previous, letter, count(*) / sum(count(*)) OVER (PARTITION BY length, previous) AS p FROM l WHERE previous IS NOT NULL GROUP BY length, previous, letter)
SELECT id, l.length, round(sum(log10(coalesce(f.p, m.p))), 6) AS log10_p FROM l LEFT JOIN f ON l.place = 1 AND f.length = l.length AND f.letter = l.letter
LEFT JOIN m ON m.length = l.length AND m.previous = l.previous AND m.letter = l.letter GROUP BY ALL""")
def sequence_logprob(spark, d):
    rows = M.letters(_words(spark, d), "id", "seq").withColumn("length", F.col("length").cast("long"))
    return rounded(M.log_probabilities(rows, "id", M.first_letter_probs(rows), M.transition_probs(rows)), "log10_p")


@query("SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS p FROM part GROUP BY p_brand, p_type")
def cond_prob_table(spark, d):
    return rounded(M.conditional_probs(table(spark, d, "part"), "p_brand", "p_type"), "p")


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size, n, round(log10(n / sum(n) OVER ()), 6) AS log10_share, log10(n / sum(n) OVER ()) > log10(2 / sum(n) OVER ()) AS above FROM c")
def observed_log_fraction(spark, d):
    return rounded(M.observed_log_fraction(table(spark, d, "part"), "p_size"), "log10_share")


@query("""SELECT page_id, regexp_extract(url, '^([^_ab.]*)', 1) AS name, reverse(translate(upper(regexp_replace(url, '[^acgt]', '', 'g')), 'ACGT', 'TGCA')) AS rc,
 CASE WHEN ends_with(url, 'x') THEN left(url, length(url) - 1) ELSE url END AS trimmed FROM pages""")
def scalar_strings(spark, d):
    pages = table(spark, d, "pages").withColumn("acgt", F.upper(F.regexp_replace("url", F.lit("[^acgt]"), F.lit(""))))
    return pages.select("page_id", X.clean_sample_name("url").alias("name"), Q.reverse_complement("acgt").alias("rc"), X.without_suffix("url", "x").alias("trimmed"))


@query("""SELECT c_custkey, (ceil(c_acctbal / 500) * 500)::DOUBLE AS up, (floor(c_acctbal / 500) * 500)::DOUBLE AS down, round(CASE WHEN c_acctbal > 0 THEN pow(10, floor(log10(c_acctbal))) END, 6) AS fold,
 CASE WHEN c_custkey % 90 < 30 THEN '<30' WHEN c_custkey % 90 < 45 THEN '30-44' WHEN c_custkey % 90 < 60 THEN '45-59' ELSE '>=60' END AS age_group FROM customer""")
def scalar_numbers(spark, d):
    rows = table(spark, d, "customer").withColumn("age", F.col("c_custkey") % 90)
    return rows.select(
        "c_custkey", X.round_up("c_acctbal", 500).cast("double").alias("up"), X.round_down("c_acctbal", 500).cast("double").alias("down"), F.round(X.decimal_fold("c_acctbal"), 6).alias("fold"), X.age_group("age").alias("age_group")
    )


@query("""WITH f AS (SELECT user_id, min(ts) AS a, max(ts) FILTER (event_type = 'click') AS b FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN date_diff('microsecond', a, b) / 3.6e9 BETWEEN 0 AND 700 THEN date_diff('microsecond', a, b) / 3.6e9 END, 6) AS hours FROM f""")
def scalar_times(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("b"))
    return rows.select("user_id", F.round(X.elapsed_hours("a", "b", 700), 6).alias("hours"))
