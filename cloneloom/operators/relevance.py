"""All-relevant selection of columns: those that beat shuffled copies of the columns in random forests, tested by sign."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.operators.cohort import written
from cloneloom.operators.ml import permuted_labels

#: Shadow columns at least, rounds at most, the depth of trees, and how often a forest should consider a column.
SHADOWS, ROUNDS, DEPTH, CONSIDERED = 5, 100, 5, 100


@dataclass
class _Column:
    name: str
    decision: str = "tentative"
    hits: int = 0
    rounds: int = 0
    p_accept: float = 1.0
    p_reject: float = 1.0
    importance: list[float] = field(default_factory=list)


def at_least(hits: int, n: int) -> float:
    """Chance of that many heads or more in n throws."""
    return min(1.0, sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n)


def passes_fdr(p: Sequence[float], alpha: float) -> list[bool]:
    """Which of some tests pass Benjamini and Hochberg's step-up procedure."""
    ordered = sorted(p)
    last = max((x for k, x in enumerate(ordered, 1) if x <= alpha * k / len(p)), default=-1.0)
    return [x <= last for x in p]


def n_trees(columns: int, depth: int) -> int:
    """Trees of a forest on so many columns and their shadows, in which a column is considered about CONSIDERED times."""
    return max(1, int(CONSIDERED * math.sqrt(2 * columns) / depth))


def decide(still: Sequence[_Column], turn: int, alpha: float) -> None:
    """Confirm or reject open columns after a round, by the p of their hits."""
    for side, decision in (("p_accept", "confirmed"), ("p_reject", "rejected")):
        p = [getattr(c, side) for c in still]
        for c, x, passed in zip(still, p, passes_fdr(p, alpha)):
            if passed and x <= alpha / turn:
                c.decision = decision


def with_shadows(rows: DataFrame, key: str, columns: Sequence[str], n: int, seed: int) -> DataFrame:
    """(key, y, values): the columns and n shadows, column 1, 2, ... in turn with the rows dealt anew for each shadow.

    A shadow's values are joined by the key that a permutation gives a row: one row a cell moves, not a row's whole columns.
    """
    dealt = permuted_labels(rows.select(key, F.col(key).alias("_other")), key, "_other", n, seed)
    cells = rows.select(F.col(key).alias("_other"), F.explode(F.array(*[F.struct(F.lit(k + 1).alias("perm"), F.col(columns[k % len(columns)]).alias("v")) for k in range(n)])).alias("_c"))
    shadows = dealt.join(cells.select("_other", "_c.*"), ["_other", "perm"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("perm", "v"))).alias("_s"))  # n entries each
    return rows.join(shadows, key).select(key, "y", F.concat(F.array(*columns), F.col("_s.v")).alias("values"))


def _importances(table: DataFrame, task: str, trees: int, depth: int, seed: int) -> np.ndarray:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    forest = {"binary": RandomForestClassifier, "regression": RandomForestRegressor}[task]
    return forest(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(table.select("y", array_to_vector("values").alias("features"))).featureImportances.toArray()


def all_relevant(df: DataFrame, key: str, y: str, columns: Sequence[str], task: str = "binary", alpha: float = 0.05, rounds: int = ROUNDS, trees: int | None = None, depth: int = DEPTH, seed: int = 1) -> DataFrame:
    """(column, decision, weak, hits, rounds, p_accept, p_reject, importance) for each column (ML3).

    A round fits a forest to the columns that are not rejected and their shadows; a column that beats the best shadow has
    a hit.  Hits are tested against fair throws on both sides: a column is confirmed or rejected where its p passes both
    the false discovery rate over the columns still open and alpha over the number of rounds.  Rejected columns leave the
    forest, whose trees follow the columns in it (``n_trees``) unless they are given, and rounds go on until no column is open or ``rounds`` are done; those left are tentative, and weak says
    whether their median importance is above the median of the best shadows.

    Keys are unique.  Rows with a null or NaN in the key, y or a column take no part; without rows or with one value of y every column stays
    tentative after no round.  The driver has one number a column and round.  A seed repeats the result on the same rows.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    names = [f"_v{i}" for i in range(len(columns))]
    rows = written(df.select(F.col(key).alias("_key"), number(y).alias("y"), *[number(c).alias(n) for c, n in zip(columns, names)]).na.drop(), "relevance")
    all_columns = {n: _Column(c) for n, c in zip(names, columns)}
    tops: list[float] = []
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    for turn in range(1, rounds + 1 if low is not None and low < high else 1):
        kept = [n for n in names if all_columns[n].decision != "rejected"]
        still = [n for n in kept if all_columns[n].decision == "tentative"]
        if not still:
            break
        table = written(with_shadows(rows.select("_key", "y", *kept), "_key", kept, max(SHADOWS, len(kept)), seed + turn), "shadows")
        found = _importances(table, task, trees or n_trees(len(kept), depth), depth, seed + turn)
        top = float(found[len(kept) :].max())
        tops.append(top)
        for n, x in zip(kept, found):
            column = all_columns[n]
            column.importance.append(float(x))
            column.hits, column.rounds = column.hits + int(x > top), turn
            column.p_accept, column.p_reject = at_least(column.hits, turn), at_least(turn - column.hits, turn)
        decide([all_columns[n] for n in still], turn, alpha)
    told = [(c.name, c.decision, c.decision == "tentative" and bool(tops) and median(c.importance) > median(tops), c.hits, c.rounds, c.p_accept, c.p_reject, float(np.mean(c.importance)) if c.importance else None) for c in all_columns.values()]
    return df.sparkSession.createDataFrame(told, "column string, decision string, weak boolean, hits int, rounds int, p_accept double, p_reject double, importance double")
