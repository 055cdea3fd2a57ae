"""The corpus pipeline: documents through quality rules, near-dedup, secret scans, mixing and tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor
kept and judges them on its own input.  Between stages the rows are written as Parquet and read again, so a
lost executor costs the stage at hand only.

- quality_rules drops documents that the current policy of the rule ledger rejects;
- simhash_near_dedup keeps of each group of near-duplicates the document with the smallest id, and of rows that
  repeat it one;
- secret_scan replaces every secret by a mark;
- source_mixing repeats, keeps, cuts or drops documents so that sources meet their targets;
- sentencepiece_encoding adds the token ids.

Null texts fail the rules and leave in the first stage; null ids come after all others and stay; empty tables pass through as empty ones; columns
beyond those of documents are dropped by the first stage that meets them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneloom.llm import mixing, pieces, quality, secrets, simhash
from cloneloom.llm.common import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.ledger(docs.select(*COLUMNS)).where(quality.kept()).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs.select(*COLUMNS), secrets.fit(docs), redact=True)
    text = F.coalesce("redacted", "text")
    return found.withColumn("n_chars", F.length(text).cast("long")).withColumn("text", text).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select(*COLUMNS), pieces.model_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SimHash, the random field and tokenising are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; only the last written one stays, which the result reads."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)  # nothing reads it any more
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
