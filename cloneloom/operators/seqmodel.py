"""Probability model of sequences: letter transitions by length, log-probabilities, conditional tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.operators.relational import share_within, with_sum


def letters(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, length, place, letter, previous) of each letter; previous is null at the first."""
    rows = df.where(F.length(seq) > 0).select(key, F.col(seq).alias("_s"), F.length(seq).alias("length"), F.explode(F.sequence(F.lit(1), F.length(seq))).alias("place"))
    return rows.select(key, "length", "place", F.substr("_s", F.col("place"), F.lit(1)).alias("letter"), F.when(F.col("place") > 1, F.substr("_s", F.col("place") - 1, F.lit(1))).alias("previous"))


#: Prior counts of letters and of letters after others (fixed values): kind -> letter -> count, kind -> previous -> letter -> count.
FIRST_PRIORS = {
    "weak constant": {"A": 1, "C": 1, "G": 1, "T": 1},
    "weak differ": {"A": 2, "C": 4, "G": 2, "T": 2},
    "strong constant": {"A": 100, "C": 100, "G": 100, "T": 100},
    "strong differ": {"A": 200, "C": 350, "G": 230, "T": 220},
}
MOVE_PRIORS = {
    "weak constant": {x: {"A": 1, "C": 1, "G": 1, "T": 1} for x in "ACGT"},
    "weak differ": {"A": {"A": 3, "C": 3, "G": 2, "T": 2}, "C": {"A": 2, "C": 5, "G": 2, "T": 2}, "G": {"A": 2, "C": 2, "G": 4, "T": 2}, "T": {"A": 2, "C": 3, "G": 2, "T": 3}},
    "strong constant": {x: {"A": 100, "C": 100, "G": 100, "T": 100} for x in "ACGT"},
    "strong differ": {"A": {"A": 300, "C": 300, "G": 200, "T": 200}, "C": {"A": 150, "C": 500, "G": 200, "T": 150}, "G": {"A": 200, "C": 200, "G": 400, "T": 200}, "T": {"A": 200, "C": 300, "G": 200, "T": 300}},
}


def insertions(df: DataFrame, end: str = "ins1", level: str = "seq", combination: Sequence[str] = ()) -> DataFrame:
    """df with insertion and its length (PM1): ins1 from n1Index to dIndex, ins2 from n2Index to jIndex as reverse complement.

    level 'combination' keeps one row of each combination of the given columns, the first by its sequence.  A missing
    index gives a null insertion of length 0.
    """
    rows = df
    if level == "combination":
        first = F.row_number().over(Window.partitionBy(*combination).orderBy("nucleotide"))
        rows = df.withColumn("_n", first).where("_n = 1").drop("_n")
    a, b = ("n1Index", "dIndex") if end == "ins1" else ("n2Index", "jIndex")
    size = F.greatest(F.col(b) - F.col(a), F.lit(0))
    part = F.substr("nucleotide", F.col(a) + 1, size)
    part = part if end == "ins1" else F.reverse(F.translate(part, "ACGT", "TGCA"))
    return rows.withColumn("insertion", part).withColumn("insertion_length", F.coalesce(F.length("insertion"), F.lit(0)))


def length_bucket(length: str, most: int) -> Column:
    """Lengths up to ``most`` as they are, those beyond together as most + 1 (PM2)."""
    return F.least(F.col(length), F.lit(most + 1))


def with_prior(counts: DataFrame, keys: Sequence[str], prior: dict) -> DataFrame:
    """(keys, letter, p) from counts (keys, letter, n) and prior counts, for each letter of the prior whether seen or not (PM2).

    ``prior`` is letter -> count, or previous -> letter -> count where keys end in 'previous'.
    """
    nested = isinstance(next(iter(prior.values())), dict)
    flat = [(x, y, n) for x, own in prior.items() for y, n in own.items()] if nested else [(None, y, n) for y, n in prior.items()]
    other = [k for k in keys if k != "previous"]
    every = F.inline(F.array(*[F.struct(F.lit(x).alias("previous"), F.lit(y).alias("letter"), F.lit(n).alias("_prior")) for x, y, n in flat]))
    cells = counts.select(*other).distinct().select(*other, every)
    cells = cells if nested else cells.drop("previous")
    rows = cells.join(counts, [*keys, "letter"], "left").withColumn("_n", F.coalesce("n", F.lit(0)) + F.col("_prior"))
    return with_sum(rows, keys, F.sum("_n"), "_total").select(*keys, "letter", (F.col("_n") / F.col("_total")).alias("p"))


def conditional_tables(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(given, then, given_value, then_value, n, p) for several pairs of columns in one pass (PM4)."""
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("given"), F.lit(b).alias("then"), F.col(a).cast("string").alias("given_value"), F.col(b).cast("string").alias("then_value")) for a, b in pairs]))
    counts = df.select(each).where("given_value is not null and then_value is not null").groupBy("given", "then", "given_value", "then_value").agg(F.count("*").alias("n"))
    return share_within(counts, ["given", "then", "given_value"], "n", "p")


def row_log_probabilities(df: DataFrame, key: str, tables: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, n_terms, log10_p): the sum of log10 P(then | given) over the pairs of columns of each row (PM4)."""
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("given"), F.lit(b).alias("then"), F.col(a).cast("string").alias("given_value"), F.col(b).cast("string").alias("then_value")) for a, b in pairs]))
    rows = df.select(key, each).join(tables.drop("n"), ["given", "then", "given_value", "then_value"])
    return rows.groupBy(key).agg(F.count("*").alias("n_terms"), F.sum(F.log10("p")).alias("log10_p"))


def first_letter_probs(rows: DataFrame) -> DataFrame:
    """(length, letter, p) of first letters (PM2)."""
    counts = rows.where("place = 1").groupBy("length", "letter").agg(F.count("*").alias("n"))
    return share_within(counts, ["length"], "n", "p").select("length", "letter", "p")


def transition_probs(rows: DataFrame, prior: float = 0.0, alphabet: int = 4) -> DataFrame:
    """(length, previous, letter, p): letter given the one before, with a flat prior count (PM2)."""
    counts = rows.where("previous is not null").groupBy("length", "previous", "letter").agg(F.count("*").alias("n"))
    total = with_sum(counts, ["length", "previous"], F.sum("n"), "_total")
    return total.select("length", "previous", "letter", ((F.col("n") + prior) / (F.col("_total") + prior * alphabet)).alias("p"))


def log_probabilities(rows: DataFrame, key: str, first: DataFrame, moves: DataFrame) -> DataFrame:
    """log10 probability of each sequence; null where a letter was never seen (PM3)."""
    a = rows.where("place = 1").join(first, ["length", "letter"], "left").select(key, "length", "p")
    b = rows.where("place > 1").join(moves, ["length", "previous", "letter"], "left").select(key, "length", "p")
    out = a.unionByName(b).groupBy(key).agg(F.first("length").alias("length"), F.count("*").alias("_n"), F.count("p").alias("_k"), F.sum(F.log10("p")).alias("log10_p"))
    return out.select(key, "length", F.when(F.col("_n") == F.col("_k"), F.col("log10_p")).alias("log10_p"))


def conditional_probs(df: DataFrame, given: str, then: str) -> DataFrame:
    """P(then | given) with counts (PM4)."""
    counts = df.where(F.col(given).isNotNull() & F.col(then).isNotNull()).groupBy(given, then).agg(F.count("*").alias("n"))
    return share_within(counts, [given], "n", "p")


def observed_log_fraction(df: DataFrame, key: str) -> DataFrame:
    """log10 of each value's share and whether that is above log10(2 / N) (PM5)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_N"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("log10_share", F.log10(F.col("n") / F.col("_N")))
    return out.withColumn("above", F.col("log10_share") > F.log10(2 / F.col("_N"))).drop("_N")
