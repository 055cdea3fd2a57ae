"""Relational preparation: filters, recoding, bins, set operations, reshaping and window helpers."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


# Running totals


#: Ranges of a running total, and rows of a group up to which it is one window, which a task can sort and spill.
BUCKETS, ONE_WINDOW = 256, 1 << 20


def running(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with running totals of columns (out: column) in an order of numbers, ties in any order, in groups (by) or over the whole table.

    Rows go into BUCKETS ranges of equal weight, whose cut points are all that reaches the driver; each range of a group
    has its own window and starts from the sum of the group's ranges before it, so no task gathers the table or a large
    group.  Where every group has ONE_WINDOW rows at most, which is counted first, each is one window: the same totals.
    """
    if by:  # often one of several in a plan: written once, so that cut points and ranges do not run what is before them again
        from cloneloom.operators.cohort import written

        df = written(df, "totals")
    key = F.col(order).desc() if descending else F.col(order).asc()
    if by and (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= ONE_WINDOW:
        small = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.sum(c).over(small) for out, c in sums.items()})
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
    bucket = _place(sorted(set(cuts)), F.col(order).cast("double"))
    rows = df.withColumn("_bucket", F.coalesce(-bucket if descending else bucket, F.lit(0)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_by_{k}" for k in by}
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()])
    starts = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_start_{out}") for out in sums]).withColumnsRenamed({**names, "_bucket": "_range"})
    own = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sure = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col("_bucket") == F.col("_range"))
    out = rows.withColumns({o: F.sum(c).over(own) for o, c in sums.items()}).join(starts if by else F.broadcast(starts), sure)
    return out.withColumns({o: F.col(o) + F.col(f"_start_{o}") for o in sums}).drop("_bucket", "_range", *names.values(), *[f"_start_{o}" for o in sums])


def _place(cuts: Sequence, value: Column) -> Column:
    """How many of the sorted cut points are below a value: first among every 16th of them, then among the 16 from there."""
    if not cuts:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    lit = lambda c: F.struct(*[F.lit(x).alias(n) for n, x in c.asDict().items()]) if isinstance(c, Row) else F.lit(c)
    steps = [F.array(*map(lit, cuts[i : i + 16])) for i in range(0, len(cuts), 16)]
    if len(steps) == 1:
        return below(steps[0])
    coarse = below(F.array(*map(lit, cuts[16::16])))
    return coarse * 16 + below(F.element_at(F.array(*steps), coarse + 1))


def places(df: DataFrame, order: str, out: str, by: Sequence[str] = (), sample: int = 4096) -> DataFrame:
    """df with the place (1..) of each row in the order of a column of any type (a struct for several), in groups (by) that share one order of magnitude of rows.

    Cut points come from a sample of ``sample`` rows; rows are counted within the ranges between them, each from the
    number of rows in those before it, so no task gathers a group.
    """
    nulls_first = lambda x: tuple((y is not None, y) for y in x) if isinstance(x, Row) else x
    seen = sorted((r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(sample).collect()), key=nulls_first)
    cuts = sorted({seen[len(seen) * i // BUCKETS] for i in range(1, BUCKETS)}, key=nulls_first) if seen else []
    rows = df.withColumn("_range", _place(cuts, F.col(order)))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order))
    return rows.join(starts, [*by, "_range"]).withColumn(out, own + F.col("_start")).drop("_range", "_start")


def places_by(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """df with the place (1..) of each row in an order of several columns, each up or down.

    Rows are dealt over ranges of the order, written once and counted in each; a range has its own window and starts from the rows before it.
    """
    from cloneloom.operators.cohort import written

    dealt = df.repartitionByRange(BUCKETS, *order).withColumn("_range", F.spark_partition_id())
    rows = written(dealt, "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn(out, own).join(F.broadcast(starts), "_range").withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")  # BUCKETS rows


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over rows that have both, as an aggregate; null, not an error, where one of them is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_sum(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """df with an aggregate of its group: aggregated before the shuffle and joined back, so that no task gathers a large group."""
    names = [f"_by_{k}" for k in by]
    sums = df.groupBy(*by).agg(value.alias(out)).withColumnsRenamed(dict(zip(by, names)))
    if not by:
        return df.crossJoin(F.broadcast(sums))  # one row
    return df.join(sums, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)])).drop(*names)


# Filters and conditional columns


def mask_range(col: str, low: float | None = None, high: float | None = None) -> Column:
    """The value, or null outside [low, high]."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(col) >= low)
    if high is not None:
        ok = ok & (F.col(col) <= high)
    return F.when(ok, F.col(col))


def floor_at_least_positive(df: DataFrame, col: str, factor: float = 1.0) -> DataFrame:
    """Values under the smallest positive cell (times factor), and nulls, become that value."""
    least = df.agg((F.min(F.when(F.col(col) > 0, F.col(col))) * factor).alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(col, F.greatest(F.coalesce(F.col(col), F.col("_least")), F.col("_least"))).drop("_least")


def binarize(col: str, threshold: float = 0.0) -> Column:
    """1 above the threshold, else 0."""
    return (F.col(col) > threshold).cast("int")


def recode(col: str, mapping: dict) -> Column:
    """Value by a map, null where it has none."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


def fill_by_policy(df: DataFrame, policies: dict[str, str | float]) -> DataFrame:
    """Fill nulls per column with 'mean', 'median', 'mode' or a constant."""
    wanted = [c for c, p in policies.items() if p in ("mean", "median", "mode")]
    out = df
    for c in wanted:
        if policies[c] == "mean":
            one = df.agg(F.avg(c).alias(f"_{c}"))
        elif policies[c] == "median":
            one = quantiles(df, c, [0.5]).select(F.col("edges")[0].alias(f"_{c}"))
        else:  # the commonest value, the least of those that tie
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias("_n"))
            one = counts.agg(F.min_by(f"_{c}", F.struct(-F.col("_n"), f"_{c}")).alias(f"_{c}"))
        out = out.crossJoin(F.broadcast(one))  # one row
    for c, p in policies.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}") if c in wanted else F.lit(p)))
    return out.drop(*[f"_{c}" for c in wanted])


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of number types."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    return [c for c, t in df.dtypes if t.startswith(kinds)]


def columns_like(df: DataFrame, ends: str | None = None, contains: str | None = None, not_starts: str | None = None) -> list[str]:
    """Columns by a predicate on their names."""
    return [
        c for c in df.columns
        if (ends is None or c.endswith(ends)) and (contains is None or contains in c) and (not_starts is None or not c.startswith(not_starts))
    ]


def drop_sparse_columns(df: DataFrame, least: int = 1) -> DataFrame:
    """Drop columns with fewer than ``least`` values."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] >= least])


# Bins and ranks


def cut(col: str, edges: Sequence[float], labels: Sequence, right: bool = True) -> Column:
    """Label of the bin (a, b], or [a, b) with right=False; null outside."""
    out = F.lit(None)
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (F.col(col) > low) & (F.col(col) <= high) if right else (F.col(col) >= low) & (F.col(col) < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def quantiles(df: DataFrame, col: str, points: Sequence[float], by: Sequence[str] = (), out: str = "edges") -> DataFrame:
    """(by, edges): the interpolated quantiles of a column of numbers, one row a group, or one row for the whole table.

    They are read off the running counts of a group's different values, which are taken in ranges, so no task keeps a
    group's values.  Nulls do not count; a group without values has null edges.
    """
    counts = df.groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(col).alias("_k"))
    upto = with_sum(running(counts, by, "_v", {"_upto": "_k"}), by, F.sum("_k"), "_all")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    places = [(F.col("_all") - 1) * q for q in points]
    known = upto if by else upto.where("_k > 0")
    ends = known.groupBy(*by).agg(F.max("_all").alias("_all"), *[at(F.floor(x)).alias(f"_lo{i}") for i, x in enumerate(places)], *[at(F.ceil(x)).alias(f"_hi{i}") for i, x in enumerate(places)])
    part = [x - F.floor(x) for x in places]
    edges = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * w for i, w in enumerate(part)]
    return ends.select(*by, F.array(*edges).alias(out))


def qcut(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """Bins 0..q-1 between interpolated quantile values, right-closed, the lowest value in bin 0."""
    edges = quantiles(df, col, [i / q for i in range(1, q)]).withColumnRenamed("edges", "_edges")
    above = F.size(F.filter("_edges", lambda e: e < F.col(col)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(col).isNotNull(), above)).drop("_edges")


def average_rank(col: str, by: Sequence[str], descending: bool = False) -> Column:
    """Rank within groups with ties at their mean (W2); for the whole table see ranked()."""
    order = F.col(col).desc() if descending else F.col(col).asc()
    ties = F.count("*").over(Window.partitionBy(*by, col))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2.0


def ranked(df: DataFrame, col: str, by: Sequence[str], out: str) -> DataFrame:
    """df with the average rank of a column without nulls, in groups or over the whole table, from running counts of its different values."""
    names = {k: f"_of_{k}" for k in by}
    values = df.groupBy(*by, F.col(col).alias("_value")).agg(F.count("*").alias("_ties"))
    counts = running(values, by, "_value", {"_upto": "_ties"}).withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col(col) == F.col("_value"))
    return df.join(counts, same).withColumn(out, F.col("_upto") - (F.col("_ties") - 1) / 2.0).drop("_value", "_ties", "_upto", *names.values())


def share_within(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """value over the sum of its group."""
    return with_sum(df, by, F.sum(value), "_sum").withColumn(out, F.try_divide(F.col(value), F.col("_sum"))).drop("_sum")


def share_above(rows: DataFrame, group: str, keys: Sequence[str], value: str, threshold: float, out: str) -> DataFrame:
    """(group, keys, out): 1 where the summed value of the keys is over a share of the group's sum, else 0 (P13 of W5).

    Values of up to 8 decimals are added up as decimals, so a sum that is just that share is not over it, in whatever
    order rows come; sums of other values, and of groups without a positive sum, are those of doubles.
    """
    exact = F.col(value).try_cast("decimal(20,8)")
    whole = F.coalesce(exact.cast("double") == F.col(value), F.col(value).isNull())
    cells = rows.groupBy(group, *keys).agg(F.sum(value).alias("_v"), F.try_sum(exact).alias("_e"), F.bool_and(whole).alias("_whole"))
    cells = with_sum(cells, [group], F.struct(F.sum("_v").alias("v"), F.try_sum("_e").alias("e"), F.bool_and("_whole").alias("whole")), "_all")
    limit, by_doubles = Decimal(repr(threshold)), F.try_divide(F.col("_v"), F.col("_all.v")) > threshold
    if abs(limit) < 1 and limit.as_tuple().exponent >= -6:
        of = F.col("_all.e").try_cast("decimal(30,8)")
        by_doubles = F.when(F.col("_all.whole") & (of > 0), F.coalesce(F.col("_e").try_cast("decimal(30,8)") > of * F.lit(limit), by_doubles)).otherwise(by_doubles)
    return cells.select(group, *keys, by_doubles.cast("int").alias(out))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def top_features(df: DataFrame, feature: str, n: int) -> DataFrame:
    """Rows of the n features with most rows, ties by name."""
    top = df.groupBy(feature).count().orderBy(F.desc("count"), feature).limit(n)
    return df.join(F.broadcast(top.select(feature)), feature, "left_semi")


def cutoff_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n largest rows and all that tie with the last of them."""
    last = df.orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(value) >= F.col("_last")).drop("_last")


# Joins


def join_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with _merge: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, list(on), "full").withColumn("_merge", side).drop("_l", "_r")


def lookup_both_ends(edges: DataFrame, names: DataFrame, ends: tuple[str, str], key: str, value: str) -> DataFrame:
    """Names of both ends of an edge table."""
    out = edges
    for end in ends:
        out = out.join(names.select(F.col(key).alias(end), F.col(value).alias(f"{end}_{value}")), end)
    return out


def merge_many(frames: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Many frames with one key and value, side by side: one union and one aggregate instead of a join each."""
    tagged = [df.select(*keys, F.col(value).alias("_v"), F.lit(name).alias("_of")) for name, df in frames.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == name, F.col("_v"))).alias(name) for name in frames])


# Set operations


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets, of what they share and have apart, and the shared part in percent of each."""
    side = lambda df, n: df.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("bit", F.lit(n))
    masks = side(left, 1).unionByName(side(right, 2)).groupBy("k").agg(F.sum("bit").alias("mask"))
    n = lambda *m: F.sum(F.col("mask").isin(*m).cast("long"))
    return masks.agg(
        n(1, 3).alias("n_left"), n(2, 3).alias("n_right"), n(3).alias("n_both"), n(1).alias("n_left_only"), n(2).alias("n_right_only"), F.count("*").alias("n_union"),
        (100.0 * n(3) / n(1, 3)).alias("pct_left"), (100.0 * n(3) / n(2, 3)).alias("pct_right"),
    )


def venn_regions(members: DataFrame, item: str, group: str, groups: Sequence) -> DataFrame:
    """Size of every region of the groups' Venn diagram, the empty ones included."""
    bits = F.bit_or(F.coalesce(*[F.when(F.col(group) == g, F.lit(1 << i)) for i, g in enumerate(groups)])).alias("mask")
    found = members.where(F.col(group).isin(*groups)).groupBy(item).agg(bits).groupBy("mask").agg(F.count("*").alias("n"))
    every = members.sparkSession.range(1, 1 << len(groups)).select(F.col("id").cast("int").alias("mask"))
    region = F.concat(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, "1").otherwise("0") for i in range(len(groups))])
    return every.join(found, "mask", "left").select(region.alias("region"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Reshaping


def pivot_unique(df: DataFrame, key: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long to wide for listed columns; a repeated cell is an error (M1)."""
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("repeated cell in pivot"))).otherwise(F.first(value))
    return df.groupBy(key).pivot(column, list(columns)).agg(cell)


def dummies(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = True) -> DataFrame:
    """One 0/1 column per level, without the first (M5)."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in list(levels)[int(drop_first):]])


def explode_list(df: DataFrame, col: str, out: str, sep: str = ",") -> DataFrame:
    """One row per item of a separated list, trimmed, empty ones left out (M6)."""
    return df.withColumn(out, F.explode(F.split(col, sep))).withColumn(out, F.trim(out)).where(F.col(out) != "")


def expand_counts(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count says (M7)."""
    return df.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))


def square(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A condensed pair table with both orders of each pair (M8)."""
    return pairs.select(a, b, value).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value))


def crosstab_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share of the row)."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    return share_within(counts, [row], "n", "share")


def fold_rare(df: DataFrame, category: str, least: int, other: str = "Other") -> DataFrame:
    """Counts of categories, those under ``least`` folded into one."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") >= least, F.col(category)).otherwise(other).alias(category)).agg(F.sum("n").alias("n"))
