"""Distances between samples, from sparse cells or dense vectors, and tests on pair tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneloom.operators.blocks import ordered_sums, pair_sums
from cloneloom.operators.cohort import shared_dir
from cloneloom.operators.relational import corr, running
from cloneloom.products import doubled, each_side, each_two, n_parts, packed, places, ranks


def all_pairs(rows: DataFrame, key: str, values: Sequence[str], chunk: int = 2048) -> DataFrame:
    """(sample1, sample2, VALUE1, VALUE2 ...) for every pair of rows: chunks of about ``chunk`` rows, written once, meet in tasks, and no pair is shuffled."""
    rows = rows.select(F.col(key).alias("sample"), *values).where("sample is not null")
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint(eager=True)
    columns = ["sample", *values]

    def run(a, b, alone: bool):
        every = a if alone else pa.concat_tables([a, b])
        for _, _, _, low, high in places(len(a), len(b), alone, ranks(every, "sample")):
            yield pa.table(each_side(every, columns, low, high))

    chunks = packed(rows, n_parts(rows.count(), chunk), chunk)
    return each_two(chunks, run, doubled({c: rows.schema[c].dataType for c in columns}))


def _carried(sizes: DataFrame, carry: DataFrame | None, sample: str) -> DataFrame:
    return sizes if carry is None else sizes.join(carry, sample)


def jaccard(cells: DataFrame, sample: str, feature: str, carry: DataFrame | None = None) -> DataFrame:
    """(sample1, sample2, dist): 1 - shared / union for every pair of samples (CL9), shared features in blocks of bits.

    carry has one row for each sample that takes part, whose columns come with its pairs (NAME1, NAME2).
    """
    rows = cells.select(sample, feature).distinct()
    pairs = pair_sums(rows, sample, feature, carry=_carried(rows.groupBy(sample).agg(F.count("*").alias("_t")), carry, sample))
    return pairs.withColumn("dist", 1 - F.col("total") / (F.col("_t1") + F.col("_t2") - F.col("total"))).drop("_t1", "_t2", "total")


def bray_curtis(cells: DataFrame, sample: str, feature: str, value: str, carry: DataFrame | None = None) -> DataFrame:
    """(sample1, sample2, dist): 1 - 2 sum of minima / sum of both (CL9); carry as in jaccard."""
    pairs = pair_sums(cells.where(F.col(value) > 0), sample, feature, value, carry=_carried(cells.groupBy(sample).agg(F.sum(value).alias("_t")), carry, sample))
    return pairs.withColumn("dist", 1 - 2 * F.col("total") / (F.col("_t1") + F.col("_t2"))).drop("_t1", "_t2", "total")


def both_distances(cells: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """(sample1, sample2, dist, dist2): Jaccard and Bray-Curtis distances of every pair of samples, from one pass over the pairs.

    cells has one row for each sample and feature at most.
    """
    positive = cells.withColumn("_v", F.coalesce(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)))
    sizes = cells.groupBy(sample).agg(F.count(feature).alias("_n"), F.sum(value).alias("_t"))
    pairs = pair_sums(positive.where(F.col(feature).isNotNull()), sample, feature, "_v", carry=sizes, counted=True)
    jac, bray = 1 - F.col("both") / (F.col("_n1") + F.col("_n2") - F.col("both")), 1 - 2 * F.col("total") / (F.col("_t1") + F.col("_t2"))
    return pairs.select("sample1", "sample2", jac.alias("dist"), bray.alias("dist2"))


#: What dense_distances returns of a pair.
DENSE = ("euclidean", "sqeuclidean", "cityblock", "canberra", "hamming")


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, which of its components are there, the lists' lengths (-1: null), and which lists have no null component."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    sizes = np.maximum(lengths, 0)
    values = pc.list_flatten(vectors)
    where = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, there = np.zeros((len(sizes), max(1, sizes.max(initial=0)))), np.zeros((len(sizes), max(1, sizes.max(initial=0))), bool)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    out[where], there[where] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), known
    return out, there, lengths, there.sum(axis=1) == lengths


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Numbers from zero on, halves rounded up; those too large to have so many digits stay."""
    if digits is None:
        return x
    many = x * 10.0**digits
    return np.where(many < 2.0**52, np.floor(many + 0.5) / 10.0**digits, x)


def dense_distances(rows: DataFrame, key: str, vector: str, chunk: int = 2048, digits: int | None = None) -> DataFrame:
    """Euclidean, squared, city-block, Canberra and Hamming distances (share of unequal components) of every pair of vectors (CL9).

    Chunks of about ``chunk`` rows are written once and meet in tasks, which add up one component after the other over all pairs of a
    block and return distances, not vectors.  A component that one of the two lacks is left out of Canberra and makes the others null.  Distances are rounded to ``digits``, if given.
    """
    rows = rows.select(F.col(key).alias("sample"), F.col(vector).cast("array<double>").alias("v")).where("sample is not null")
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint(eager=True)

    def run(a: pa.Table, b: pa.Table, alone: bool) -> Iterator[pa.Table]:
        every = a if alone else pa.concat_tables([a, b])
        x, there, lengths, full = _matrix(every.column("v").combine_chunks())
        columns, present, whole = np.ascontiguousarray(x.T), np.ascontiguousarray(there.T), bool(there.all())
        shift, odd = 0 if alone else len(a), bool(np.isnan(x).any())
        for first, end, at, low, high in places(len(a), len(b), alone, ranks(every, "sample"), 1 << 15):
            square, block, canberra, away, size = (np.zeros((end - first, len(b))) for _ in range(5))
            unequal = np.zeros(square.shape, np.int32)
            with np.errstate(all="ignore"):
                for k in range(len(columns)):
                    p, q = columns[k, first:end, None], columns[k, None, shift : shift + len(b)]
                    np.subtract(p, q, out=away)
                    square += np.multiply(away, away, out=size)
                    block += np.abs(away, out=away)
                    unequal += ((p != q) & ~(np.isnan(p) & np.isnan(q)) if odd else p != q).view(np.uint8)  # not-a-numbers are equal to Spark
                    away /= np.add(np.abs(p), np.abs(q), out=size)
                    if not (p.all() or q.all()):
                        away[size == 0] = 0
                    if not whole:
                        away[~(present[k, first:end, None] & present[k, None, shift : shift + len(b)])] = 0
                    canberra += away
                n = np.broadcast_to(lengths[None, shift : shift + len(b)], square.shape).ravel()[at]
                told = [m.ravel()[at] for m in (square, block, canberra, unequal)]
                figures = dict(zip(DENSE, (np.sqrt(told[0]), *told[:3], told[3] / n)))
            lost = ~(full[low] & full[high] & (lengths[low] == lengths[high]))
            masks = {c: lost for c in DENSE} | {"canberra": (lengths[low] < 0) | (lengths[high] < 0), "hamming": lost | (lengths[low] == 0)}
            yield pa.table({**each_side(every, ["sample"], low, high), **{c: pa.array(_rounded(v, digits), mask=masks[c]) for c, v in figures.items()}})

    chunks = packed(rows, n_parts(rows.count(), chunk), chunk)
    schema = T.StructType(doubled({"sample": rows.schema["sample"].dataType}).fields + [T.StructField(c, T.DoubleType()) for c in DENSE])
    return each_two(chunks, run, schema)


def mantel_r(x: DataFrame, y: DataFrame | None, relabel: DataFrame | None = None) -> DataFrame:
    """Correlation of two pair tables (sample1, sample2, dist) (ST21); relabel (perm, sample, other) permutes y's samples.

    Without y, x has both distances of a pair (dist, dist2), and pairs are not joined.
    """
    if relabel is None:
        both = x if y is None else x.join(y.withColumnRenamed("dist", "dist2"), ["sample1", "sample2"])
        return both.agg(F.count("*").alias("n"), corr("dist", "dist2").alias("r"))
    a = relabel.select("perm", F.col("sample").alias("sample1"), F.col("other").alias("o1"))
    b = relabel.select("perm", F.col("sample").alias("sample2"), F.col("other").alias("o2"))
    moved = x.join(a, "sample1").join(b, ["perm", "sample2"]).withColumn("lo", F.least("o1", "o2")).withColumn("hi", F.greatest("o1", "o2"))
    both = moved.join(y.select(F.col("sample1").alias("lo"), F.col("sample2").alias("hi"), F.col("dist").alias("dist2")), ["lo", "hi"])
    return both.groupBy("perm").agg(corr("dist", "dist2").alias("r"))


def mantel_both(cells: DataFrame, sample: str, feature: str, value: str, size: int | None = None) -> DataFrame:
    """mantel_r of both_distances: blocks of pairs return sums about 1, not pairs, unless features take several blocks (``size``)."""
    counts = cells.groupBy(sample).agg(F.count(feature).alias("_n"), F.sum(value).alias("_t"))
    rows = cells.where(F.col(feature).isNotNull()).select(F.col(sample).alias("s"), F.col(feature).alias("f"), F.coalesce(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    names = ("n", "x", "y", "xx", "yy", "xy")

    def told(a: pa.Table, b: pa.Table, first: int, end: int, low: np.ndarray, both: np.ndarray) -> pa.Table:
        (n1, n2), (t1, t2) = ([t.column(c).to_numpy().astype(float) for t in (a, b)] for c in ("_n", "_t"))
        with np.errstate(all="ignore"):
            x = both / (n1[first:end, None] + n2[None, :] - both)
            y = 2 * low / (t1[first:end, None] + t2[None, :])
        known = ~(np.isnan(x) | np.isnan(y))
        x, y = -x[known], -y[known]  # distances less 1
        return pa.table(dict(zip(names, ([v] for v in (float(len(x)), x.sum(), y.sum(), x @ x, y @ y, x @ y)))) | {"every": [int((~np.isnan(low)).sum())]})

    found = pair_sums(rows, "s", "f", "v", size=size, carry=counts.withColumnRenamed(sample, "s"), counted=True, told=(told, ", ".join(f"{c} double" for c in names) + ", every long"))
    if "sample1" in found.columns:
        return mantel_r(both_distances(cells, sample, feature, value), None)
    sums = found.agg(*[F.sum(c).alias(c) for c in (*names, "every")])
    spread = lambda c: F.sqrt(F.col(c * 2) - F.col(c) * F.col(c) / F.col("n"))
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), spread("x") * spread("y"))
    return sums.select(F.coalesce("every", F.lit(0)).alias("n"), r.alias("r"))


def permanova_f(pairs: DataFrame, groups: DataFrame, sample: str, group: str) -> DataFrame:
    """Pseudo-F of squared pair distances (ST22); pairs that carry the groups of their samples (g1, g2) are not joined with them."""
    g1, g2 = groups.select(F.col(sample).alias("sample1"), F.col(group).alias("g1")), groups.select(F.col(sample).alias("sample2"), F.col(group).alias("g2"))
    sizes = groups.groupBy(F.col(group).alias("g1")).agg(F.count("*").alias("k"))
    rows = pairs if {"g1", "g2"} <= set(pairs.columns) else pairs.join(g1, "sample1").join(g2, "sample2")
    rows = rows.join(F.broadcast(sizes), "g1")
    square = F.col("dist") ** 2
    sums = rows.agg(F.sum(square).alias("all"), F.sum(F.when(F.col("g1") == F.col("g2"), square / F.col("k"))).alias("within"))
    counts = sizes.agg(F.sum("k").alias("n"), F.count("*").alias("a"))
    between = F.col("all") / F.col("n") - F.col("within")
    return sums.crossJoin(counts).select("n", F.col("a").alias("groups"), F.try_divide(F.try_divide(between, F.col("a") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("a"))).alias("f"))


def pair_classes(pairs: DataFrame, groups: DataFrame, sample: str, flag: str) -> DataFrame:
    """Pairs with the number of their samples that bear a flag: 0, 1 or 2 (ST23); pairs that carry the flags (FLAG1, FLAG2) are not joined with them."""
    if {f"{flag}1", f"{flag}2"} <= set(pairs.columns):
        return pairs.withColumn("n_flagged", F.col(f"{flag}1") + F.col(f"{flag}2")).drop(f"{flag}1", f"{flag}2")
    a, b = groups.select(F.col(sample).alias("sample1"), F.col(flag).alias("f1")), groups.select(F.col(sample).alias("sample2"), F.col(flag).alias("f2"))
    return pairs.join(a, "sample1").join(b, "sample2").withColumn("n_flagged", F.col("f1") + F.col("f2")).drop("f1", "f2")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with their place in the order of distances, ties by their samples.

    Places within a distance come from its own window, those before it from the running count of distances.
    """
    counts = running(pairs.groupBy(F.col("dist").alias("_d")).agg(F.count("*").alias("_n")), [], "_d", {"_upto": "_n"})
    own = F.row_number().over(Window.partitionBy("dist").orderBy("sample1", "sample2"))
    return pairs.join(counts, F.col("dist") == F.col("_d")).withColumn("place", own + F.col("_upto") - F.col("_n")).drop("_d", "_n", "_upto")


def ordered_shared(cells: DataFrame, sample: str, sequence: str, chunk: int | None = None, size: int | None = None) -> DataFrame:
    """(sample1, sample2, dist, place): pairs of samples by the sequences that both have (dist), with their place in that order, ties by their samples.

    Tasks number the pairs that they make; only where sequences take several blocks, sums are shuffled by pair and then by distance.
    """
    rows = cells.select(sample, sequence).distinct()
    pairs = ordered_sums(rows, sample, sequence, chunk, size)
    if pairs is None:
        pairs = ordered_pairs(pair_sums(rows, sample, sequence, chunk=chunk, size=size).select("sample1", "sample2", F.col("total").alias("dist")))
        return pairs.withColumn("dist", F.col("dist").cast("double"))
    return pairs.select("sample1", "sample2", F.col("total").cast("double").alias("dist"), "place")
