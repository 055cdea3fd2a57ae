"""One query per training-data operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cloneloom.llm import chat, decontaminate, mixing, negatives, pieces, prefixes, quality, secrets, simhash, substrings, suffixes, vectors, warc
from cloneloom.llm.common import shared_dir, table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_schedule(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("virtual_finish", 9).alias("virtual_finish")
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.model_path(), keep_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "parity", "round_trip")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality.kept("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), quality.kept().alias("kept"), "failed",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the bits of one ledger."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents").select("text")).select("failed"), list(quality.POLICIES))


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path, compression="gzip")
    # Bytes that hold no record would be lost pages: the query fails rather than leave them out.
    lost = F.raise_error(F.concat(F.lit("no record in bytes of "), F.col("path"))).cast("boolean")
    records = warc.read_warc(spark, path).where(F.when(F.col("kind") == "record", True).otherwise(lost))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secrets.find_secrets(docs, secrets.fit(docs))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(*prefixes.rebuilt_turns(table(spark, sf_dir, "conversations")))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    formatted = chat.format_chat(messages)
    turns = chat.parse_chat(F.col("formatted"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("turns", turns)
        .withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.size("attachments").cast("long").alias("n_attachments"),
            "expanded_tokens",
        )
    )


QUERIES = {f.__name__: f for f in (op1_suffix_array, op2_simhash, op3_mix_sources, op4_sentencepiece, op5_quality_rules, op6_secret_scan, op7_substring_dedup, op8_chat_format, op9_embedding_links, op10_warc, op11_decontaminate, op12_hard_negatives, op13_prefix_trie)}
QUERIES |= {"pipeline": corpus_pipeline.run, "quality_ablation": quality_ablation}

#: The ledger of quality rules in SQL: f has the measurements and the bits.
LEDGER = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
p AS (SELECT doc_id, i, ws[i:i+4] AS win FROM w, unnest(generate_series(1, len(ws) - 4)) t(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha_words,
        len(list_filter(ws, lambda x: x IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'))) AS n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
        + CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 64 ELSE 0 END
        + CASE WHEN 100 * n_alpha_words < 70 * n_words THEN 128 ELSE 0 END + CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 256 ELSE 0 END
        + CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 512 ELSE 0 END + CASE WHEN n_stop_words < 2 THEN 1024 ELSE 0 END)::BIGINT AS failed FROM m)"""
ABLATION = "pol(policy, mask) AS (VALUES " + ", ".join(f"('{p}', {quality.mask(p)})" for p in quality.POLICIES) + "), rul(rule, bit) AS (VALUES " + ", ".join(
    f"('{r}', {1 << i})" for i, r in enumerate(quality.RULES)
) + """)
SELECT policy, rule, count(*) FILTER (failed & bit > 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_failed_alone, count(*) AS n_docs,
       count(*) FILTER (failed & mask IN (0, bit)) AS n_kept_without
FROM f, pol, rul WHERE mask & bit > 0 GROUP BY policy, rule"""

ORACLES = {
    "op9_embedding_links": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""",
    "op5_quality_rules": LEDGER + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept, failed FROM f""",
    "quality_ablation": LEDGER + ", " + ABLATION,
    "op10_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k""",
    "op3_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, '')))) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
      FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS cap,
        (sum(source_size) OVER () - sum(3 * source_size) OVER o + 3 * source_size)::DOUBLE / sum(weight) OVER r AS level
      FROM s
      WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING),
             r AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size,
        least(cap::DOUBLE, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target FROM l),
q AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, (SELECT sum(size) FROM d)::BIGINT AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS through
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, e * source_size + through - size + 64 * k AS start, least(64, size - 64 * k) AS words
      FROM (SELECT *, unnest(range((size + 63) // 64)) AS k FROM q), (SELECT unnest(range(3)) AS e)),
p AS (SELECT *, sum(words) OVER (ORDER BY (start + words) / target, source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS sent
      FROM k WHERE start / target < 1),
n AS (SELECT source, through, sum(greatest(0, least(words, budget - sent + words)))::BIGINT AS taken FROM p GROUP BY source, through)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS taken,
  round(CASE WHEN target > 0 THEN q.through / target ELSE 0 END, 9) AS virtual_finish
FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.through = n.through""",
    "op11_decontaminate": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS gram FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
p AS (SELECT r, i, n, w[i:i + n - 1] AS gram FROM d, (SELECT DISTINCT n FROM g) s, unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT r, i, g.n, item FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) t(k) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND k <= 5 AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY place) AS own FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda s, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(s, c)), 4294967295), 4294967295) % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n_turns, d AS depth, turns[1:d] AS prefix FROM r, unnest(range(0, len(turns) + 1)) x(d)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_turns) = depth AS leaf,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '') AS ends, (count(*) - 1) * coalesce(length(prefix[depth].t), 0) AS saved FROM p GROUP BY depth, prefix),
s AS (SELECT a.depth, a.prefix, sum(b.leaf::INT)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.depth = a.depth + 1) AS n_children
  FROM n a JOIN n b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY a.depth, a.prefix)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON n.depth = s.depth AND n.prefix = s.prefix LEFT JOIN n q ON q.depth = n.depth - 1 AND q.prefix = n.prefix[1:n.depth - 1]""",
    "op8_chat_format": r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length('<|turn|>' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') || chr(10)
        || replace(replace(text, '%', '%25'), '<', '%3C') || '<|end|>' || chr(10)) AS chars FROM m),
a AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(chars)::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM a""",
}
