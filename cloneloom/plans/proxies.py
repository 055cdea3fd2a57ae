"""The test tables in the roles of the domain's tables, in Spark and as SQL of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rearrangement: lineitem with its part."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("sample"),
        F.col("l_partkey").alias("nucleotide"),
        F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("amino_acid"),
        F.col("l_quantity").cast("int").alias("templates"),
        F.col("l_extendedprice").alias("frequency"),
        (F.col("l_returnflag") != "R").alias("productive"),
        F.col("l_linestatus").alias("status"),
        F.col("p_brand").alias("v_gene"),
        F.col("p_type").alias("j_gene"),
        F.col("p_size").alias("cdr3_length"),
        F.col("l_discount").alias("v_deletion"),
        F.col("l_tax").alias("j_deletion"),
    )


REPERTOIRE = """rep AS (
  SELECT l_suppkey AS sample, l_partkey AS nucleotide, p_brand || ':' || p_size AS amino_acid, l_quantity::INT AS templates,
         l_extendedprice AS frequency, l_returnflag <> 'R' AS productive, l_linestatus AS status, p_brand AS v_gene,
         p_type AS j_gene, p_size AS cdr3_length, l_discount AS v_deletion, l_tax AS j_deletion
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, sequence, frequency): the long sharing matrix, one row per present cell."""
    return repertoire(spark, sf_dir).groupBy("sample", F.col("amino_acid").alias("sequence")).agg(F.sum("frequency").alias("frequency"))


SHARING = REPERTOIRE + """,
share AS (SELECT sample, amino_acid AS sequence, sum(frequency) AS frequency FROM rep GROUP BY ALL)"""


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, feature, abundance): relative abundance of each event type per user."""
    from cloneloom.operators.relational import share_within

    sums = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("feature")).agg(F.sum("value").alias("value"))
    return share_within(sums, ["sample"], "value", "abundance").select("sample", "feature", "abundance")


SPECIES = """species AS (
  SELECT user_id AS sample, event_type AS feature, sum(value) / sum(sum(value)) OVER (PARTITION BY user_id) AS abundance
  FROM events GROUP BY user_id, event_type)"""


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, cohort): suppliers of even and odd nations."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_nationkey") % 2).cast("int").alias("cohort"))


COHORTS = "cohorts AS (SELECT s_suppkey AS sample, (s_nationkey % 2)::INT AS cohort FROM supplier)"
