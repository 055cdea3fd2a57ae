"""Per-sample features of a repertoire: clonality, diversity, lengths, gene usage, sampling in closed form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.operators.relational import places, quantiles, share_within, with_sum

#: Standard deviations by which a sample's templates may have fewer low hashes than asked for, before all are taken.
SLACK = 8


def clone_shares(df: DataFrame, sample: str, clone: str, weight: str) -> DataFrame:
    """(sample, clone, w, p): weight of each clone and its share of the sample."""
    sums = df.where(F.col(clone).isNotNull()).groupBy(sample, clone).agg(F.sum(weight).alias("w"))
    return share_within(sums, [sample], "w", "p")


def shannon(p: str = "p") -> Column:
    """Entropy in bits over shares."""
    return -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0))


def simpson(p: str = "p") -> Column:
    """1 - sum of squared shares."""
    return 1 - F.sum(F.col(p) * F.col(p))


def berger_parker(p: str = "p") -> Column:
    """Largest share."""
    return F.max(p)


def diversity(df: DataFrame, sample: str, clone: str, weight: str) -> DataFrame:
    shares = clone_shares(df, sample, clone, weight)
    return shares.groupBy(sample).agg(
        F.count("*").alias("richness"), F.sum("w").alias("total"), shannon().alias("shannon"), simpson().alias("simpson"), berger_parker().alias("berger_parker")
    )


def top_clones(shares: DataFrame, sample: str, tops: Sequence[int], clone: str) -> DataFrame:
    """Share of the k largest clones, null where a sample has fewer."""
    # A limit on the rank is applied to each task's rows before the shuffle.
    ranked = shares.withColumn("_n", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc("p"), clone))).where(F.col("_n") <= max(tops))
    return ranked.groupBy(sample).agg(*[F.when(F.count("*") >= k, F.sum(F.when(F.col("_n") <= k, F.col("p")))).alias(f"top_{k}") for k in tops])


def clone_percentiles(shares: DataFrame, sample: str, points: Sequence[float] = (0.01, 0.5, 0.999)) -> DataFrame:
    """Interpolated percentiles, mean and population deviation of clone shares."""
    names = [f"p{str(100 * q).rstrip('0').rstrip('.').replace('.', '_')}" for q in points]
    edges = quantiles(shares, "p", points, [sample]).withColumnRenamed(sample, "_sample")
    moments = shares.groupBy(sample).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
    return moments.join(edges, F.col(sample).eqNullSafe(F.col("_sample"))).select(sample, *[F.col("edges")[i].alias(n) for i, n in enumerate(names)], "mean", "std")


def column_stats(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """mean, sample deviation and maximum of each column (A5)."""
    return df.groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.max, "max"))])


def coefficient_of_variation(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Population deviation over mean."""
    return df.groupBy(by).agg(*[(F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0))).alias(f"{c}_cv") for c in columns])


def convergence(df: DataFrame, sample: str, nucleotide: str, amino_acid: str) -> DataFrame:
    """Largest and mean number of nucleotide clones per amino-acid clone (A10)."""
    per = df.groupBy(sample, amino_acid).agg(F.count_distinct(nucleotide).alias("n"))
    return per.groupBy(sample).agg(F.max("n").alias("max_nt_per_aa"), F.avg("n").alias("mean_nt_per_aa"))


def gc_percent(col: str) -> Column:
    """Percent of G, C and S among the letters of a sequence."""
    return F.when(F.length(col) > 0, 100.0 * F.regexp_count(col, F.lit("[GCSgcs]")) / F.length(col))


def usage(df: DataFrame, sample: str, genes: Sequence[str]) -> DataFrame:
    """(sample, gene, n, share) of a gene or a combination of genes."""
    present = df.where(" and ".join(f"{g} is not null" for g in genes)).withColumn("gene", F.concat_ws("_", *genes))
    return share_within(present.groupBy(sample, "gene").agg(F.count("*").alias("n")), [sample], "n", "share")


def productive_percent(df: DataFrame, sample: str, weight: str) -> DataFrame:
    """Percent productive by weight and by rows."""
    return df.groupBy(sample).agg(
        (100.0 * F.sum(F.when(F.col("productive"), F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("pct_weight"),
        (100.0 * F.avg(F.col("productive").cast("int"))).alias("pct_rows"),
    )


def matrix_diversity(cells: DataFrame, sample: str, value: str, scale: float) -> DataFrame:
    """Diversity of abundances made whole numbers by a scale; components, mean, largest and their ratio."""
    whole = cells.withColumn("w", F.floor(F.col(value) * scale)).where("w > 0")
    shares = share_within(whole, [sample], "w", "p")
    found = shares.groupBy(sample).agg(shannon().alias("shannon"), simpson().alias("simpson"), berger_parker().alias("berger_parker"))
    plain = cells.where(F.col(value) > 0).groupBy(sample).agg(F.count("*").alias("n_components"), F.avg(value).alias("mean_ra"), F.max(value).alias("max_ra"))
    return plain.withColumn("max_to_mean", F.col("max_ra") / F.col("mean_ra")).join(found, sample, "left")


def feature_profile(df: DataFrame, columns: Sequence[str], sentinel: float = 9999) -> DataFrame:
    """Nulls, sentinels, distinct values, commonest value's share and type of each column (P25)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    per = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = per.groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("value") == sentinel, F.col("n"))), F.lit(0)).alias("n_sentinel"),
        F.count("value").alias("n_distinct"), (F.max(F.when(F.col("value").isNotNull(), F.col("n"))) / F.sum("n")).alias("top_share"),
    )
    kind = F.when(F.col("n_distinct") <= 1, "constant").when(F.col("n_distinct") == 2, "binary").when(F.col("n_distinct") <= 5, "categorial").otherwise("Continuous")
    return out.withColumn("type", kind)


def weighted_histogram(df: DataFrame, by: str, col: str, weight: str, low: float, high: float, bins: int) -> DataFrame:
    """Weight per equal-width bin and its running sum."""
    counts = df.withColumn("bin", F.width_bucket(F.col(col), F.lit(float(low)), F.lit(float(high)), F.lit(bins))).groupBy(by, "bin").agg(F.sum(weight).alias("weight"))
    running = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cumulative", F.sum("weight").over(running))


# Sampling


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, to 1e-11: Stirling's series, after a shift by 8 where x is small."""
    x = x.cast("double")

    def series(y: Column) -> Column:
        inverse = 1 / (y * y)
        tail = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
        return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + tail

    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return F.when(x >= 8, series(x)).otherwise(series(x + 8) - F.ln(product))


def share_missed(total: Column, count: Column, draw: Column) -> Column:
    """Chance that none of ``count`` among ``total`` is in a draw without replacement: C(total - count, draw) / C(total, draw)."""
    rest = total - count
    log = log_gamma(rest + 1) - log_gamma(rest - draw + 1) - log_gamma(total + 1) + log_gamma(total - draw + 1)
    return F.when(rest >= draw, F.exp(log)).otherwise(0.0)


def expected_richness(counts: DataFrame, sample: str, count: str, draw: int) -> DataFrame:
    """Expected distinct clones in ``draw`` templates without replacement; null where a sample has fewer.

    E = sum of 1 - C(N - n_i, draw) / C(N, draw).
    """
    sizes = counts.groupBy(sample, count).agg(F.count("*").alias("_k"))  # clones of one count share a term
    rows = with_sum(sizes, [sample], F.sum(F.col(count) * F.col("_k")), "_N")
    missed = share_missed(F.col("_N"), F.col(count), F.lit(draw))
    return rows.groupBy(sample).agg(F.first("_N").alias("total"), F.sum(F.col("_k") * (1 - missed)).alias("expected")).select(
        sample, "total", F.when(F.col("total") >= draw, F.col("expected")).alias("expected")
    )


def rarefaction_curve(counts: DataFrame, sample: str, count: str, step: int) -> DataFrame:
    """Expected distinct clones at every ``step`` templates up to the sample's total.

    Clones of one count share a term, so a sample costs (different counts) x (points), not (clones) x (points).
    """
    sizes = counts.groupBy(sample, count).agg(F.count("*").alias("k"))
    rows = with_sum(sizes, [sample], F.sum(F.col(count) * F.col("k")), "_N")
    rows = rows.where(F.col("_N") >= step).withColumn("draw", F.explode(F.sequence(F.lit(step).cast("long"), F.col("_N").cast("long"), F.lit(step).cast("long"))))
    missed = share_missed(F.col("_N"), F.col(count), F.col("draw"))
    return rows.groupBy(sample, "draw").agg(F.sum(F.col("k") * (1 - missed)).alias("expected"))


def downsample(df: DataFrame, sample: str, keys: Sequence[str], count: str, n: int, seed: int) -> DataFrame:
    """Exactly n templates of each sample without replacement: (sample, keys, drawn); smaller samples are left out.

    Templates are ordered by a hash of the seed, the clone and the copy.  Of a sample with many only those travel whose
    hash is low enough to be among the first n; a sample that has fewer than n of them is taken anew with all.
    """
    from cloneloom.operators.cohort import written
    from cloneloom.operators.relational import expand_counts

    totals = df.where(F.col(count) > 0).groupBy(F.col(sample).alias("_s")).agg(F.sum(F.col(count).cast("double")).alias("_all")).where(F.col("_all") >= n)
    counts = df.select(sample, *keys, count).join(totals, F.col(sample).eqNullSafe(F.col("_s"))).drop("_s")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in (sample, *keys)], F.col("copy").cast("string")).cast("binary"))
    order = Window.partitionBy(sample).orderBy("_h", *keys, "copy")

    def first(rows: DataFrame, likely: bool) -> DataFrame:
        rows = expand_counts(rows, count).drop(count)
        if likely:  # the first eight digits of the n-th hash are hardly ever over this
            most = (n + SLACK * math.sqrt(n) + 32) / F.col("_all") * (1 << 32)
            rows = rows.where(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") <= most)
        ranked = rows.withColumn("_h", F.unhex(key)).withColumn("_n", F.row_number().over(order)).where(f"_n <= {n}")
        return ranked.groupBy(sample, *keys).agg(F.count("*").alias("drawn"))

    drawn = written(first(counts, True), "drawn")
    full = drawn.groupBy(F.col(sample).alias("_s")).agg(F.sum("drawn").alias("_k")).where(f"_k = {n}").select("_s")
    left = totals.join(full.withColumnRenamed("_s", "_f"), F.col("_s").eqNullSafe(F.col("_f")), "left_anti").select("_s")
    short = written(left, "short")
    if short.isEmpty():
        return drawn
    again = counts.join(short, F.col(sample).eqNullSafe(F.col("_s"))).drop("_s")
    return drawn.join(short, F.col(sample).eqNullSafe(F.col("_s")), "left_anti").unionByName(first(again, False))


# Sharing


def sharing_counts(cells: DataFrame, sequence: str, sample: str) -> DataFrame:
    """Samples per sequence, and 1 where that is two or more."""
    return cells.groupBy(sequence).agg(F.count_distinct(sample).alias("n_shared")).withColumn("is_public", (F.col("n_shared") >= 2).cast("int"))


def public_rates(cells: DataFrame, sequence: str, sample: str, thresholds: Sequence[int]) -> DataFrame:
    """Per sample: percent public, percent in more samples than each threshold, mean sharing."""
    shared = cells.select(sample, sequence).distinct().join(sharing_counts(cells, sequence, sample), sequence)
    return shared.groupBy(sample).agg(
        (100 * F.avg("is_public")).alias("pct_public"), *[(100 * F.avg((F.col("n_shared") > t).cast("int"))).alias(f"pct_over_{t}") for t in thresholds], F.avg("n_shared").alias("mean_shared")
    )


def prevalent(cells: DataFrame, sequence: str, n_samples: int | Column, low: float, high: float) -> DataFrame:
    """Cells of the sequences in at least ceil(low n) and fewer than ceil(high n) samples (P20)."""
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    kept = cells.groupBy(sequence).agg(F.count("*").alias("_k")).where((F.col("_k") >= F.ceil(n * low)) & (F.col("_k") < F.ceil(n * high)))
    return cells.join(kept, sequence, "left_semi")


def shared_pairs(cells: DataFrame, sample: str, sequence: str, carry: DataFrame | None = None) -> DataFrame:
    """(sample1, sample2, n_shared): sequences that two samples share (CL10); carry has one row for each sample that takes part, whose columns come with its pairs (NAME1, NAME2)."""
    from cloneloom.operators.blocks import pair_sums

    pairs = pair_sums(cells.select(sample, sequence).distinct(), sample, sequence, carry=carry)
    return (pairs if carry is None else pairs.where("total > 0")).withColumnRenamed("total", "n_shared")


def pairs_within(cells: DataFrame, sample: str, key: str, values: Sequence[str] = (), chunk: int = 1024) -> DataFrame:
    """(sample1, sample2, key, VALUE1, VALUE2 ...) for each pair of samples that share a key.

    A key's samples are dealt over chunks of about ``chunk``, and pairs of chunks are the join's keys: a key that a
    third of all samples share is many small joins.
    """
    rows = with_sum(cells.select(sample, key, *values), [key], F.count("*"), "_n").where("_n > 1")
    chunks = F.ceil(F.col("_n") / chunk).cast("int")
    rows = rows.withColumn("_m", chunks).withColumn("_c", F.pmod(F.xxhash64(sample), chunks).cast("int"))
    every = F.sequence(F.lit(0), F.col("_m") - 1)
    a = rows.select(F.col(sample).alias("sample1"), key, *[F.col(v).alias(f"{v}1") for v in values], F.col("_c").alias("_i"), F.explode(every).alias("_j"))
    b = rows.select(F.col(sample).alias("sample2"), key, *[F.col(v).alias(f"{v}2") for v in values], F.col("_c").alias("_j"), F.explode(every).alias("_i"))
    return a.join(b, [key, "_i", "_j"]).where("sample1 < sample2").drop("_i", "_j")


def sample_rarefaction(cells: DataFrame, sample: str, sequence: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """Sequences, public share and sharing among the first k samples of a seeded order."""
    order = cells.select(sample).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(sample).cast("string")).cast("binary")))
    order = places(order, "_h", "_at").where(F.col("_at") <= max(sizes))
    ks = F.filter(F.array(*map(F.lit, sizes)), lambda k: k >= F.col("_at"))
    rows = cells.select(sample, sequence).distinct().join(order, sample).withColumn("k", F.explode(ks))
    per = rows.groupBy("k", sequence).agg(F.count("*").alias("n"))
    return per.groupBy("k").agg(F.count("*").alias("n_sequences"), (100 * F.avg((F.col("n") >= 2).cast("int"))).alias("pct_public"), F.avg("n").alias("mean_shared"), F.max("n").alias("max_shared"))
