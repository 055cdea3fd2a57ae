"""Exact subsampling of counts without listing what is counted.

n of a sample's templates are drawn without replacement by dividing n over ranges of clones and then over the clones of
each range, every division a hypergeometric draw; so the work follows the clones, however many templates they have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.functions.special import log_hypergeometric

#: Clones of a range; sums up to which numpy draws; deviations from the mode that an inverse draw looks at.
RANGE, DIRECT, WIDE = 4096, 10**9, 14


def hypergeometric(marked: int, rest: int, n: int, u: float) -> int:
    """The marked ones in a draw of n from marked + rest, by the inverse of the distribution at u, summed from the mode outwards."""
    whole = marked + rest
    low, high = max(0, n - rest), min(n, marked)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (marked + 1) // (whole + 2)))
    spread = WIDE * math.sqrt(n * (marked / whole) * (rest / whole) * ((whole - n) / max(whole - 1, 1))) + 50
    k = np.arange(max(low, int(mode - spread)), min(high, int(mode + spread)) + 1, dtype=float)
    p = np.cumsum(np.exp(log_hypergeometric(k, float(n), float(marked), float(whole))))
    return int(k[min(int(np.searchsorted(p, u * p[-1])), len(k) - 1)])


def divided(counts: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of n drawn templates fall on each count."""
    total = int(counts.sum())
    if total < DIRECT:
        return draw.multivariate_hypergeometric(counts, n, method="marginals")
    if len(counts) == 1:
        return np.array([n])
    half = len(counts) // 2
    first = int(counts[:half].sum())
    k = hypergeometric(first, total - first, n, draw.random())
    return np.concatenate([divided(counts[:half], k, draw), divided(counts[half:], n - k, draw)])


def _generator(*names) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(":".join(map(str, names)).encode()).digest()[:8], "little"))


def subsample(df: DataFrame, sample: str, keys: Sequence[str], count: str, n: int, seed: int = 1, size: int = RANGE) -> DataFrame:
    """(sample, keys, drawn): exactly n templates of each sample that has as many, without replacement.

    Rows of one clone are added up; clones without templates, or drawn none, are left out.  Clones lie in ranges of a hash of
    about ``size`` clones; a sample's n is divided over its ranges in one small group, then over each range's clones.
    Draws depend on the seed, the sample and the range only, so reruns agree, however rows are spread.
    """
    rows = df.where(F.col(count) > 0).groupBy(sample, *keys).agg(F.sum(F.col(count).cast("long")).alias("_k"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), sample, *keys))
    most = rows.groupBy(sample).count().agg(F.max("count")).first()[0] or 1
    rows = rows.withColumn("_range", F.pmod("_h", F.lit(max(1, -(-most // size)))))
    totals = rows.groupBy(sample, "_range").agg(F.sum("_k").alias("_k"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def over_ranges(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_range").to_numpy())
        table = table.take(pa.array(order))
        counts = table.column("_k").to_numpy()
        take = divided(counts, n, _generator(seed, "ranges", table.column(sample)[0].as_py())) if counts.sum() >= n else np.zeros(len(counts), np.int64)
        return table.drop_columns("_k").append_column("_take", pa.array(take, pa.int64()))

    def over_clones(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("_k").to_numpy(), table.column("_h").to_numpy()))))
        name = seed, table.column(sample)[0].as_py(), table.column("_range")[0].as_py()
        drawn = divided(table.column("_k").to_numpy(), table.column("_take")[0].as_py(), _generator(*name))
        return table.select([sample, *keys]).append_column("drawn", pa.array(drawn, pa.int64()))

    takes = totals.groupBy(sample).applyInArrow(over_ranges, f"{sample} {kinds[sample]}, _range long, _take long").where("_take > 0")
    met = rows.withColumnRenamed(sample, "_s").withColumnRenamed("_range", "_r").join(takes, F.col("_s").eqNullSafe(F.col(sample)) & (F.col("_r") == F.col("_range"))).drop("_s", "_r")
    schema = ", ".join(f"{c} {kinds[c]}" for c in (sample, *keys)) + ", drawn long"
    return met.groupBy(sample, "_range").applyInArrow(over_clones, schema).where("drawn > 0")
