"""Cleaning feature tables, prevalence and metadata filters, named aggregates, matrix orders and set tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneloom.operators.associations import correlation_matrix
from cloneloom.operators.cohort import written
from cloneloom.operators.relational import places, quantiles, with_sum
from cloneloom.operators.repertoire import feature_profile
from cloneloom.operators.stats import no_outlier_mean

# Filters


def prevalent_in_any(cells: DataFrame, groups: DataFrame, sample: str, sequence: str, group: str, share: float, most: float = 1.1) -> DataFrame:
    """Cells of the sequences that ceil(share n) samples of some group or of all have, and fewer than ceil(most n) of all."""
    rows = cells.select(sample, sequence).distinct().join(groups, sample)
    both = rows.withColumn("_g", F.explode(F.array(F.col(group).cast("string"), F.lit("all"))))
    sizes = groups.withColumn("_g", F.explode(F.array(F.col(group).cast("string"), F.lit("all")))).groupBy("_g").agg(F.count("*").alias("_n"))
    counts = both.groupBy("_g", sequence).agg(F.count("*").alias("_k")).join(sizes, "_g")
    kept = counts.groupBy(sequence).agg(F.max((F.col("_k") >= F.ceil(F.col("_n") * share)).cast("int")).alias("_in"), F.max(F.when(F.col("_g") == "all", (F.col("_k") < F.ceil(F.col("_n") * most)).cast("int"))).alias("_few"))
    return cells.join(kept.where("_in = 1 and _few = 1"), sequence, "left_semi")


def by_properties(df: DataFrame, meta: DataFrame, key: str, not_equal: dict | None = None, above: dict | None = None, among: dict | None = None) -> DataFrame:
    """Rows whose metadata, left-joined, pass all conditions.

    A null passes ``not_equal`` (what is unknown is not the value) and fails ``above`` and ``among``.
    """
    out = df.join(meta, key, "left")
    tests = [~F.col(c).eqNullSafe(F.lit(v)) for c, v in (not_equal or {}).items()]
    tests += [F.col(c) > v for c, v in (above or {}).items()] + [F.col(c).isin(*v) for c, v in (among or {}).items()]
    return out.where(reduce(Column.__and__, tests, F.lit(True))).select(*df.columns)


#: Marks in the names of two correlated columns: the first of the pair goes if the mark tells so, else the second.
MARKS = (("_T", False), ("_0", True), ("_std", True), ("-", True))


def loser(a: str, b: str) -> Column:
    """Which of two correlated columns, named in columns a and b, is dropped, a before b in the table."""
    goes = [(F.contains(a, F.lit(mark)) == in_first) & (F.contains(b, F.lit(mark)) != in_first) for mark, in_first in MARKS]
    return F.when(reduce(Column.__or__, goes), F.col(a)).otherwise(F.col(b))


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float, least: int = 6) -> list[str]:
    """Columns to drop: those with fewer than ``least`` values, and of every two with r of at least the threshold one.

    Only positive r counts, over the rows where both have a value; pairs are taken in blocks of columns.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    full = [c for c in columns if counts[c] >= least]
    losers = correlation_matrix(df, full).where(F.col("r") >= threshold).select(loser("a", "b").alias("c")).distinct()
    gone = {c for c in columns if counts[c] < least} | {r.c for r in losers.collect()}  # column names at most
    return [c for c in columns if c in gone]


def cleaned(df: DataFrame, columns: Sequence[str], threshold: float = 1.0, keep_nulls: str = "norm") -> DataFrame:
    """df without correlated columns, nulls 0 but in columns named like ``keep_nulls``, and without constant columns."""
    gone = correlated_columns(df, columns, threshold)
    left = [c for c in columns if c not in gone]
    out = df.drop(*gone).fillna(0, subset=[c for c in left if keep_nulls not in c])
    constant = [r.feature for r in feature_profile(out, left).where("type = 'constant'").select("feature").collect()] if left else []
    return out.drop(*constant)


def aligned(x: DataFrame, y: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """(sample1, sample2, x, y) of two pair tables on the samples that both have, pairs of one user left out if users (sample, user) are given.

    Without y, x has both distances (x, y) and the users of its samples (u1, u2; null: not known): pairs are not joined.
    """
    if y is None:
        return x.where(~F.col("u1").eqNullSafe(F.col("u2")) | F.col("u1").isNull()).select("sample1", "sample2", "x", "y")
    out = x.select("sample1", "sample2", F.col("dist").alias("x")).join(y.select("sample1", "sample2", F.col("dist").alias("y")), ["sample1", "sample2"])
    if users is None:
        return out
    of = lambda i: users.select(F.col("sample").alias(f"sample{i}"), F.col("user").alias(f"u{i}"))
    return out.join(of(1), "sample1", "left").join(of(2), "sample2", "left").where(~F.col("u1").eqNullSafe(F.col("u2")) | F.col("u1").isNull()).drop("u1", "u2")


# Aggregates by name


def _frequent(c: str) -> Column:
    return F.mode(c, True)


#: Aggregates of a column by name (UD3, A23, A24).
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_samp, "count": F.count, "n_distinct": F.count_distinct,
    "most_frequent": _frequent, "any_positive": lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)), "list": lambda c: F.array_sort(F.collect_set(c)),
}


def named_aggregates(df: DataFrame, by: Sequence[str], wanted: dict[str, Sequence[str]], productive: str = "productive") -> DataFrame:
    """One column FUNCTION_COLUMN_PART for each wanted aggregate and each part: total, prod and nonprod (UD3).

    Different values are counted from the table's different (group, value) rows, each with the parts that it is in, so that no row is
    sent once for each part.
    """
    parts = {"total": F.lit(True), "prod": F.col(productive), "nonprod": ~F.col(productive)}
    plain = {f: cs for f, cs in wanted.items() if f != "n_distinct"}
    columns = {f"_{c}_{p}": F.when(test, F.col(c)) for c in dict.fromkeys(c for cs in plain.values() for c in cs) for p, test in parts.items()}
    rows = df.select(*by, *[v.alias(n) for n, v in columns.items()])
    found = [rows.groupBy(*by).agg(*[AGGREGATES[f](f"_{c}_{p}").alias(f"{f}_{c}_{p}") for f, cs in plain.items() for c in cs for p in parts])] if any(plain.values()) else []
    for c in wanted.get("n_distinct", ()):
        seen = df.select(*by, F.col(c).alias("_value"), F.col(productive).alias("_prod")).groupBy(*by, "_value").agg(F.bool_or("_prod").alias("_in_prod"), F.bool_or(~F.col("_prod")).alias("_in_nonprod"))
        within = {"total": F.lit(True), "prod": F.col("_in_prod"), "nonprod": F.col("_in_nonprod")}
        found.append(seen.groupBy(*by).agg(*[F.count(F.when(test, F.col("_value"))).alias(f"n_distinct_{c}_{p}") for p, test in within.items()]))
    out, names = found[0], [f"_by_{k}" for k in by]
    for other in found[1:]:
        same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)]
        out = out.join(other.withColumnsRenamed(dict(zip(by, names))), same).drop(*names) if by else out.crossJoin(other)  # without groups one row each
    return out.select(*by, *[f"{f}_{c}_{p}" for f, cs in wanted.items() for c in cs for p in parts])


def merged_on(df: DataFrame, by: Sequence[str], value: str, how: str) -> DataFrame:
    """One value a group by a function's name: 'no_outlier_mean' or one of AGGREGATES."""
    if how == "no_outlier_mean":
        return no_outlier_mean(df, by, value).withColumnRenamed("mean", value)
    return df.groupBy(*by).agg(AGGREGATES[how](value).alias(value))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, max)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def read_quality(df: DataFrame, sample: str, weight: str, status: str) -> DataFrame:
    """(sample, status, n, weight, share of the sample's rows and weight)."""
    counts = df.groupBy(sample, status).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    out = with_sum(with_sum(counts, [sample], F.sum("n"), "_n"), [sample], F.sum("weight"), "_w")
    return out.withColumn("share_n", F.col("n") / F.col("_n")).withColumn("share_weight", F.try_divide("weight", "_w")).drop("_n", "_w")


def matrix_sums(cells: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Sums of a sparse matrix over its rows and over its columns."""
    return cells.groupBy(row).agg(F.sum(value).alias("total"), F.count("*").alias("n")), cells.groupBy(column).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def least_column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n): how often each column holds the row's least value, the first of equal ones."""
    least = F.least(*columns)
    first = F.coalesce(*[F.when(F.col(c) == least, F.lit(c)) for c in columns])
    return df.select(first.alias("column")).where("column is not null").groupBy("column").agg(F.count("*").alias("n"))


def sampled_rows(df: DataFrame, group: str, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows of each group in the order of a seeded hash of their keys; smaller groups whole (R2)."""
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in (group, *keys)]).cast("binary"))
    first = F.row_number().over(Window.partitionBy(group).orderBy("_h", *keys))
    return df.withColumn("_h", name).withColumn("_n", first).where(F.col("_n") <= n).drop("_h", "_n")


def sharing_after_sampling(cells: DataFrame, cohorts: DataFrame, sample: str, sequence: str, cohort: str, n: int, seed: int, shared: int = 2) -> DataFrame:
    """(cohort, sample, n_sequences, n_public, pct_public) with n sequences of each sample; public in ``shared`` samples of the cohort."""
    rows = sampled_rows(cells.select(sample, sequence).distinct(), sample, [sequence], n, seed).join(cohorts, sample)
    public = rows.groupBy(cohort, sequence).agg((F.count("*") >= shared).cast("int").alias("_public"))
    per = rows.join(public, [cohort, sequence]).groupBy(cohort, sample).agg(F.count("*").alias("n_sequences"), F.sum("_public").alias("n_public"))
    return per.withColumn("pct_public", 100.0 * F.col("n_public") / F.col("n_sequences"))


def rates_by_group(rates: DataFrame, groups: DataFrame, sample: str, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean of per-sample rates in each group."""
    return rates.join(groups, sample).groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def percentile_list(df: DataFrame, group: str, value: str, points: Sequence[int] = tuple(range(0, 101))) -> DataFrame:
    """(group, percentile, value): interpolated percentiles of each group."""
    got = quantiles(df, value, [p / 100 for p in points], [group], "_p")
    return got.select(group, F.posexplode("_p").alias("_i", "value")).select(group, F.element_at(F.array(*map(F.lit, points)), F.col("_i") + 1).alias("percentile"), "value")


def row_ranks(columns: Sequence[str]) -> dict[str, Column]:
    """Average rank of each column among the row's values, nulls left out."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    below = lambda c: F.size(F.filter(values, lambda x: x < F.col(c)))
    same = lambda c: F.size(F.filter(values, lambda x: x == F.col(c)))
    return {c: F.when(F.col(c).isNotNull(), below(c) + (same(c) + 1) / 2.0) for c in columns}


# Orders


def matrix_order(cells: DataFrame, row: str, column: str, value: str, by: str = "max") -> tuple[DataFrame, DataFrame]:
    """(row, place) and (column, place) in descending order of their largest or mean value, ties by name."""
    f = {"max": F.max, "mean": F.avg}[by]

    def placed(c: str) -> DataFrame:
        # Values as a column of their own order: places cuts it into ranges.
        order = F.struct((-F.col("_v")).alias("v"), F.col(c).alias("name"))
        return places(cells.groupBy(c).agg(f(value).cast("double").alias("_v")).withColumn("_order", order), "_order", "place").select(c, "place")

    return placed(row), placed(column)


def nth_by_count(cells: DataFrame, sample: str, n: int) -> DataFrame:
    """(sample, n_rows): the n-th sample from the smallest by its number of rows, to choose a depth."""
    counts = cells.groupBy(sample).agg(F.count("*").alias("n_rows"))
    return counts.orderBy("n_rows", sample).limit(n).orderBy(F.desc("n_rows"), F.desc(sample)).limit(1)


# Sets and shapes


def replicate_membership(cells: DataFrame, sequence: str, replicate: str, value: str, replicates: Sequence) -> DataFrame:
    """(sequence, one column a replicate with the summed value, n_replicates)."""
    out = cells.where(F.col(replicate).isin(*replicates)).groupBy(sequence).agg(*[F.sum(F.when(F.col(replicate) == r, F.col(value))).alias(f"rep_{r}") for r in replicates])
    return out.withColumn("n_replicates", sum(F.col(f"rep_{r}").isNotNull().cast("int") for r in replicates))


def subset_pairs(members: DataFrame, group: str, item: str, chunk: int = 2048) -> DataFrame:
    """(inner, outer) of groups all of whose items another group has (U9): shared items by an equi-join, counted against the size.

    Groups of equal items are one set, named by one of them, and only different sets are compared.  Equal items are found
    by a hash of the set and then counted; a group that shares a hash but not the items is a set of its own.  The groups of
    two sets meet by chunks of about ``chunk``, as lists that are taken apart last: no pair of groups is shuffled.
    """
    spark = members.sparkSession
    rows = written(members.select(F.col(group).alias("_g"), F.col(item).alias("_i")).where("_g is not null").distinct(), "items")
    hashes = [F.bit_xor(F.when(F.col("_i").isNotNull(), F.xxhash64(F.lit(i), "_i"))).alias(f"_h{i}") for i in (1, 2)]
    sized = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.count("_i").alias("_m"), *hashes)  # a null item is in no other group
    named = with_sum(sized.where("_m > 0"), ["_n", "_m", "_h1", "_h2"], F.min("_g"), "_set")
    theirs = rows.select(F.col("_g").alias("_set"), "_i")
    equal = rows.join(named.where("_g <> _set"), "_g").join(theirs, ["_set", "_i"]).groupBy("_g").agg(F.count("*").alias("_k"))
    named = named.join(equal, "_g", "left").select("_g", "_n", F.when(F.col("_k") == F.col("_m"), F.col("_set")).otherwise(F.col("_g")).alias("_set"))
    named = written(named, "sets")
    items = rows.join(named.where("_g = _set").select("_g", "_n"), "_g")
    a, b = items.select(F.col("_g").alias("_inner"), "_i", "_n"), items.select(F.col("_g").alias("_outer"), "_i")
    under = a.join(b, "_i").groupBy("_inner", "_outer", "_n").agg(F.count("*").alias("_k")).where("_k = _n").select("_inner", "_outer")
    chunks = with_sum(named, ["_set"], F.count("*"), "_k").withColumn("_c", F.pmod(F.xxhash64("_g"), F.ceil(F.col("_k") / chunk)))
    packs = written(chunks.groupBy("_set", "_c").agg(F.collect_list("_g").alias("_gs")), "sets")  # about chunk groups each
    left = packs.select(F.col("_set").alias("_inner"), F.col("_c").alias("_ci"), F.col("_gs").alias("_a"))
    right = packs.select(F.col("_set").alias("_outer"), F.col("_c").alias("_co"), F.col("_gs").alias("_b"))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = left.join(under, "_inner").join(right, "_outer").repartition(parts, "_inner", "_ci", "_outer", "_co")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                inner, outer = (batch.column(c)[k].values for c in ("_a", "_b"))
                for first in range(0, len(inner), 64):
                    some = inner.slice(first, 64)
                    i, j = pa.array(np.repeat(np.arange(len(some)), len(outer))), pa.array(np.tile(np.arange(len(outer)), len(some)))
                    out = pa.RecordBatch.from_pydict({"inner": some.take(i), "outer": outer.take(j)})
                    yield out.filter(pc.not_equal(out.column(0), out.column(1)))

    kind = members.schema[group].dataType
    return met.select("_a", "_b").mapInArrow(pairs, T.StructType([T.StructField("inner", kind), T.StructField("outer", kind)]))


def pivot_mean(df: DataFrame, key: str, column: str, value: str, columns: Sequence, fill: float = 0.0) -> DataFrame:
    """Long to wide with means, absent cells filled (M2)."""
    return df.groupBy(key).pivot(column, list(columns)).agg(F.avg(value)).na.fill(fill)


def transposed(df: DataFrame, key: str, columns: Sequence[str], keys: Sequence) -> DataFrame:
    """Columns become rows and the listed keys columns (M4)."""
    return df.where(F.col(key).isin(*keys)).unpivot(key, list(columns), "column", "value").groupBy("column").pivot(key, list(keys)).agg(F.first("value"))


def annotated(df: DataFrame, annotations: DataFrame, key: str, sep: str = ";") -> DataFrame:
    """df left-joined with its annotations, a row for each match, and with them as one sorted list."""
    listed = annotations.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), sep).alias("labels"), F.count("*").alias("n_labels"))
    return df.join(annotations, key, "left").join(listed, key, "left").na.fill({"n_labels": 0})


def new_outcomes(df: DataFrame, outcomes: Sequence[str], days: str, early: int) -> DataFrame:
    """df with any_outcome, and early_outcome: 1 within ``early`` days, 0 without any outcome, else null."""
    some = F.coalesce(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in outcomes]) if len(outcomes) > 1 else F.col(outcomes[0]), F.lit(0))
    return df.withColumn("any_outcome", some).withColumn("early_outcome", F.when((some == 1) & (F.col(days) <= early), 1).when(some == 0, 0))
