"""Tests of association and their corrections.  Statistics are Spark expressions; p-values come from special."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.functions import special
from cloneloom.operators.relational import corr, ranked, running, with_sum


def correlations(df: DataFrame, by: Sequence[str], x: str, y: str, method: str = "pearson") -> DataFrame:
    """n, r and two-sided p of pairs without nulls (ST1, ST2); ranks average ties; null where a column is constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "spearman":
        rows = ranked(ranked(rows, x, by, "_x"), y, by, "_y")
        x, y = "_x", "_y"
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), corr(x, y).alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    exact = F.abs(F.col("r")) >= 1
    return out.withColumn("p", F.when(F.col("n") < 3, None).when(exact, 0.0).otherwise(special.t_p(F.when(exact, 0.0).otherwise(t), F.greatest(F.col("n") - 2, F.lit(1)).cast("double"))))


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, group: str, alternative: str = "two-sided") -> DataFrame:
    """n1, n2, u1, u2, z, p per feature; group is 1 or 0 (ST3).

    Normal approximation with tie and continuity corrections; 'legacy' halves p.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(group)).alias("_n1"), F.count("*").alias("_n"))
    ranks = running(counts, by, value, {"_upto": "_n"}).withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2.0)
    out = ranks.groupBy(*by).agg(
        F.sum("_n1").alias("n1"), (F.sum("_n") - F.sum("_n1")).alias("n2"), F.sum(F.col("_n1") * F.col("_rank")).alias("_r1"), F.sum(F.col("_n").cast("double") ** 3 - F.col("_n")).alias("_ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u1", F.col("_r1") - n1 * (n1 + 1) / 2).withColumn("u2", n1 * n2 - F.col("u1"))
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = out.withColumn("z", F.try_divide(F.greatest(F.abs(F.col("u1") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd))
    p = special.normal_p("z") * (0.5 if alternative == "legacy" else 1.0)
    return out.withColumn("p", F.least(p, F.lit(1.0))).drop("_r1", "_ties")


def t_test(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """Student's t with equal variances, nulls left out (ST4); t is null with an empty group or no variance."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    out = df.groupBy(*by).agg(*[f(of(g)).alias(f"{n}{g}") for g in (1, 0) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))])
    return with_t(out)


def with_t(out: DataFrame) -> DataFrame:
    """Rows of n, mean and var of groups 1 and 0 with t and p."""
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = F.try_divide((n1 - 1) * F.coalesce("var1", F.lit(0.0)) + (n0 - 1) * F.coalesce("var0", F.lit(0.0)), n1 + n0 - 2)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean0"), scale))
    return out.withColumn("p", special.t_p("t", F.greatest(n1 + n0 - 2, F.lit(1)).cast("double")))


def anova(df: DataFrame, by: Sequence[str], value: str, group: str) -> DataFrame:
    """One-way analysis of variance (ST6); f is null with one group, or where no group varies.

    Sums of squares are taken about means (variance times count), so values far from zero lose nothing.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    own = rows.groupBy(*by, group).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count("*")).alias("_w"))
    means = own.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("_n").alias("n"), F.sum(F.col("_m") * F.col("_n")).alias("_t"), F.sum("_w").alias("_within"))
    means = means.select(*[F.col(k).alias(f"_by_{k}") for k in by], "groups", "n", "_within", (F.col("_t") / F.col("n")).alias("_grand"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by], F.lit(True))
    between = own.join(means, same).groupBy(*by, "groups", "n", "_within").agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_grand")) ** 2).alias("_between"))
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    out = between.withColumn("f", F.try_divide(F.try_divide(F.col("_between"), df1), F.try_divide(F.col("_within"), df2)))
    return out.withColumn("p", special.f_p("f", F.greatest(df1, F.lit(1)).cast("double"), F.greatest(df2, F.lit(1)).cast("double"))).drop("_within", "_between")


def ks_two_sample(df: DataFrame, by: Sequence[str], value: str, group: str, weight: str | None = None) -> DataFrame:
    """Largest distance of two empirical distributions (ST5); null where one of them is empty.  A row counts ``weight`` times, if given."""
    times = F.col(weight) if weight else F.lit(1)
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(group) * times).alias("_a"), F.sum((1 - F.col(group)) * times).alias("_b"))
    totals = counts.groupBy(*by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"))
    steps = running(counts, by, value, {"_up_a": "_a", "_up_b": "_b"})
    steps = steps.join(totals, list(by)) if by else steps.crossJoin(F.broadcast(totals))
    gap = F.abs(F.try_divide("_up_a", "n1") - F.try_divide("_up_b", "n2"))
    out = steps.groupBy(*by, "n1", "n2").agg(F.max(gap).alias("d"))
    return out.withColumn("p", special.ks_p("d", F.col("n1").cast("double"), F.col("n2").cast("double")))


def chi_square(df: DataFrame, by: Sequence[str], row: str, column: str, yates: bool = True) -> DataFrame:
    """chi2, degrees, p and Cramer's V of an r x c table; Yates' correction on 2 x 2 (ST8, ST9).

    Cells that never occur count with their expectation: their sum is n minus that of the cells that do.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, row, column).agg(F.count("*").alias("_o"))
    for keys, out in (([row], "_r"), ([column], "_c"), ([], "_n")):
        cells = with_sum(cells, [*by, *keys], F.sum("_o"), out)
    cells = cells.withColumn("_e", F.col("_r") * F.col("_c") / F.col("_n"))
    sizes = cells.groupBy(*by).agg(
        F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"), F.first("_n").alias("n"), F.count("*").alias("_k"),
        F.sum((F.col("_o") - F.col("_e")) ** 2 / F.col("_e")).alias("_x"), F.sum("_e").alias("_seen"),
        F.sum((F.abs(F.col("_o") - F.col("_e")) - F.least(F.lit(0.5), F.abs(F.col("_o") - F.col("_e")))) ** 2 / F.col("_e")).alias("_y"),
        F.max(F.abs(F.col("_o") - F.col("_e"))).alias("_gap"),
    )
    missing = F.col("n") - F.col("_seen")
    two = (F.col("rows") == 2) & (F.col("columns") == 2)
    gap = F.col("_gap")
    unseen = F.when(F.col("_k") == 4, 0.0).otherwise(missing * F.try_divide((gap - F.least(F.lit(0.5), gap)) ** 2, gap**2))
    chi2 = F.when(two, F.col("_y") + unseen).otherwise(F.col("_x") + missing) if yates else F.col("_x") + missing
    out = sizes.withColumn("chi2", chi2).withColumn("degrees", (F.col("rows") - 1) * (F.col("columns") - 1))
    v = F.sqrt(F.try_divide(F.col("_x") + missing, F.col("n") * F.least(F.col("rows") - 1, F.col("columns") - 1)))
    return out.withColumn("v", v).withColumn("p", special.chi2_p("chi2", F.greatest("degrees", F.lit(1)).cast("double"))).select(*by, "n", "chi2", "degrees", "v", "p")


def fisher_exact(tables: DataFrame, a: str, b: str, c: str, d: str, p: str = "p") -> DataFrame:
    """Two-sided p and sample odds ratio of 2 x 2 tables (ST7).

    p sums the hypergeometric probabilities that are not above the table's own.  An undefined ratio is 999999.
    """
    A, B, C, D = (F.col(x).cast("long") for x in (a, b, c, d))
    ratio = F.coalesce(F.try_divide((A * D).cast("double"), (B * C).cast("double")), F.lit(999999.0))
    return tables.withColumn(p, special.fisher_p(A, B, C, D)).withColumn("odds_ratio", ratio)


def odds_ratio_ci(tables: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Odds ratio with Woolf's 95 % interval and whether that leaves out 1 (ST12); null with an empty cell."""
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    ok = (A > 0) & (B > 0) & (C > 0) & (D > 0)
    log = F.when(ok, F.ln(A * D / (B * C)))
    half = F.when(ok, 1.96 * F.sqrt(1 / A + 1 / B + 1 / C + 1 / D))
    out = tables.withColumn("odds_ratio", F.exp(log)).withColumn("ci_low", F.exp(log - half)).withColumn("ci_high", F.exp(log + half))
    return out.withColumn("significant", (F.col("ci_low") > 1) | (F.col("ci_high") < 1))


def adjusted(df: DataFrame, p: str, method: str = "bh", by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """df with the adjusted p of each test, 'bh' or 'bonferroni' (ST10) or 'holm-sidak' (ST11); nulls stay null.

    Equal p share one adjusted value, so the steps run over different values with their counts.  A step's extreme
    over all values above (or below) it is the extreme within its range and that of whole ranges beyond.
    """
    keys = list(by)
    tests = df.where(F.col(p).isNotNull())
    sizes = tests.groupBy(*keys).agg(F.count("*").alias("_n"))
    values = tests.groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    values = running(values, keys, "_p", {"_upto": "_k"})
    values = values.join(sizes, keys) if keys else values.crossJoin(F.broadcast(sizes))
    if method == "bonferroni":
        values = values.withColumn("_q", F.col("_p") * F.col("_n"))
    elif method == "bh":
        values = _extreme_beyond(values.withColumn("_step", F.col("_p") * F.col("_n") / F.col("_upto")), keys, up=True)
    else:
        # The first of equal values has the largest step.
        values = _extreme_beyond(values.withColumn("_step", 1 - (1 - F.col("_p")) ** (F.col("_n") - (F.col("_upto") - F.col("_k")))), keys, up=False)
    values = values.select(*[F.col(k).alias(f"_by_{k}") for k in keys], "_p", F.least("_q", F.lit(1.0)).alias(out))
    on = [F.col(p) == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]]
    return df.join(values, on, "left").drop("_p", *[f"_by_{k}" for k in keys])


def _extreme_beyond(values: DataFrame, keys: list[str], up: bool, ranges: int = 256) -> DataFrame:
    """_q: least _step at this _p or above (up), or largest at this _p or below."""
    best = F.min if up else F.max
    frame = (Window.currentRow, Window.unboundedFollowing) if up else (Window.unboundedPreceding, Window.currentRow)
    rows = values.withColumn("_range", F.floor(F.col("_upto") * ranges / (F.col("_n") + 1)))
    own = Window.partitionBy(*keys, "_range").orderBy("_p").rowsBetween(*frame)
    other = (1, Window.unboundedFollowing) if up else (Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*other)
    whole = rows.groupBy(*keys, "_range").agg(best("_step").alias("_whole")).withColumn("_rest", best("_whole").over(across)).drop("_whole")
    pick = F.least if up else F.greatest
    joined = rows.join(whole, [*keys, "_range"]).withColumn("_own", best("_step").over(own))
    return joined.withColumn("_q", F.coalesce(pick("_own", "_rest"), "_own"))


def outlier_mask(df: DataFrame, columns: Sequence[str], sigmas: float, bounds: str = "both", least: int = 0) -> DataFrame:
    """Values beyond mean +- sigmas * deviation become null (P17-P19); bounds 'upper' cuts above only."""
    stats = df.agg(*[f(c).alias(f"_{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_samp, "s"), (F.count, "n"))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        m, s, n = (F.col(f"_{c}_{x}") for x in "msn")
        beyond = F.col(c) > m + sigmas * s
        beyond = beyond | (F.col(c) < m - sigmas * s) if bounds == "both" else beyond
        out = out.withColumn(c, F.when(~(beyond & (s > 0) & (n > least)), F.col(c)))
    return out.select(*df.columns)


def no_outlier_mean(df: DataFrame, by: Sequence[str], value: str, sigmas: float = 3, least: int = 3) -> DataFrame:
    """Mean without values beyond sigmas population deviations, where a group has more than ``least``."""
    rows = with_sum(df, by, F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n")), "_own")
    m, s, n = (F.col(f"_own.{x}") for x in "msn")
    rows = rows.withColumn("_in", (n <= least) | (s == 0) | (F.abs(F.col(value) - m) <= sigmas * s))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("_in"), F.col(value))), F.avg(value)).alias("mean"))


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score (population deviation) and 0..1 scaling of each column."""
    stats = df.agg(*[f(c).alias(f"_{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"), (F.min, "lo"), (F.max, "hi"))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"{c}_z", F.try_divide(F.col(c) - F.col(f"_{c}_m"), F.col(f"_{c}_s")))
        out = out.withColumn(f"{c}_unit", F.try_divide(F.col(c) - F.col(f"_{c}_lo"), F.col(f"_{c}_hi") - F.col(f"_{c}_lo")))
    return out.drop(*[f"_{c}_{n}" for c in columns for n in ("m", "s", "lo", "hi")])


def residuals(df: DataFrame, y: str, x: str, fit_on: Column) -> DataFrame:
    """y minus the line fitted where fit_on holds (ST25)."""
    line = df.where(fit_on).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def binary_association(cells: DataFrame, samples: DataFrame, sample: str, feature: str, value: str, group: str) -> DataFrame:
    """Each feature against a binary label: presence table, Fisher, Mann-Whitney on abundance with absent cells as 0 (ST13, ST14).

    cells are sparse (sample, feature, value > 0); absent samples enter by arithmetic: they form the lowest tie.  Samples
    without a label take no part.
    """
    samples = samples.where(F.col(group).isNotNull())
    sizes = samples.agg(F.sum(group).alias("_N1"), F.count(group).alias("_N"))
    present = cells.join(samples.select(sample, group), sample).where(F.col(value) > 0)
    own = Window.partitionBy(feature)
    counts = present.groupBy(feature, value).agg(F.sum(group).alias("_k1"), F.count("*").alias("_k"), F.sum(F.col(value) * F.col(group)).alias("_v1"), F.sum(value).alias("_v"))
    below = own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.crossJoin(F.broadcast(sizes)).withColumn("_zeros", F.col("_N") - F.sum("_k").over(own))
    counts = counts.withColumn("_rank", F.col("_zeros") + F.coalesce(F.sum("_k").over(below), F.lit(0)) + (F.col("_k") + 1) / 2.0)
    out = counts.groupBy(feature).agg(
        F.sum("_k1").alias("present1"), (F.sum("_k") - F.sum("_k1")).alias("present0"), F.first("_N1").alias("_N1"), F.first("_N").alias("_N"),
        F.first("_zeros").alias("_zeros"), F.sum(F.col("_k1") * F.col("_rank")).alias("_r1"), F.sum(F.col("_k").cast("double") ** 3 - F.col("_k")).alias("_ties"),
        F.sum("_v1").alias("_v1"), F.sum("_v").alias("_v"),
    )
    n1, n0, n = F.col("_N1").cast("double"), (F.col("_N") - F.col("_N1")).cast("double"), F.col("_N").cast("double")
    out = out.withColumn("absent1", F.col("_N1") - F.col("present1")).withColumn("absent0", F.col("_N") - F.col("_N1") - F.col("present0"))
    out = out.withColumn("mean1", F.try_divide(F.col("_v1"), n1)).withColumn("mean0", F.try_divide(F.col("_v") - F.col("_v1"), n0))
    zeros = F.col("_zeros").cast("double")
    out = out.withColumn("u1", F.col("_r1") + F.col("absent1") * (zeros + 1) / 2 - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties") + zeros**3 - zeros, n * (n - 1))))
    out = out.withColumn("p_mw", F.least(special.normal_p(F.try_divide(F.greatest(F.abs(F.col("u1") - n1 * n0 / 2) - 0.5, F.lit(0.0)), sd)), F.lit(1.0)))
    out = fisher_exact(out, "present1", "absent1", "present0", "absent0", "p_fisher").withColumn("direction", F.when(F.col("odds_ratio") >= 1, 1).otherwise(-1))
    return out.select(feature, "present1", "absent1", "present0", "absent0", "mean1", "mean0", "u1", "p_mw", "p_fisher", "odds_ratio", "direction")


def signed_log_p(p: str, direction: str) -> Column:
    """-log10 p with the sign of the direction."""
    return F.col(direction) * -F.log10(F.greatest(F.col(p), F.lit(1e-300)))


def merge_triads(cs: DataFrame, cp: DataFrame, sp: DataFrame) -> DataFrame:
    """cluster-species, cluster-phenotype and species-phenotype links joined; direction_ok is 0 iff c_s = s_p + c_p (ST20)."""
    joined = cs.join(cp, "cluster").join(sp, ["species", "phenotype"])
    return joined.withColumn("direction_ok", F.when(F.col("c_s") == F.col("s_p") + F.col("c_p"), 0).otherwise(1))
