"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Components become whole numbers (floor of 256 x).  For each of several primes near 1000 the numbers' residues, centred
on 0, are multiplied as float32 matrices: with at most ``DEPTH`` components at a time every partial sum stays below
2**24, where float32 is exact.  The residues of a score under all primes give the score by Chinese remaindering (mixed
radix, the way of Garner), for as many primes as the largest possible score needs: that is the longest anchor times the
longest row.

Anchors are a stated query set, searched in blocks of ``block`` anchors against all rows; each task holds one block and
a piece of the rows it reads, and rows are not shuffled.  A first pass finds each anchor's positives: the best of its
label in each task, then of those over all tasks.  A second pass finds, for the score window of every positive, the
best rows of other labels in the same way.  A task remembers the ``keep``-th best so far of each anchor and window, so
that nearly all later scores are dropped by one comparison.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part, as anchors or as
candidates; vectors of several lengths count as filled up with zeros; rows with a null id are no anchors and come
last among equal scores; an anchor's own row is no candidate, other rows that repeat its id are, and repeated rows take
a place each; a repeated anchor is mined once for each of its rows; an anchor without positives or a positive without
negatives gives no rows; a window of a negative positive score is empty; empty tables give an empty result; other columns
are ignored, whatever their names.  Components whose scores could pass 2**58 are an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage

#: The largest primes under 1024; their product is under 2**63.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
#: Components of a partial product: 64 x 510 x 510 is under 2**24.
DEPTH = 64
SCALE = 256
#: Anchors in a block at most, and bytes of their vectors; rows and anchors that a task multiplies at a time.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
PIECE, ANCHORS_AT_ONCE = 2048, 512
NO_ID = np.iinfo(np.int64).max
HIT = "anchor int, place int, row long, vec_id long, score long"


def whole(batches):
    """vec_id, label, vec (components as little-endian long integers), norm2 (its squared length)."""
    for batch in batches:
        ids, labels, rows = batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int64()), batch.column("embedding")
        keep, vecs, norms = [], [], []
        for i, value in enumerate(rows):
            if labels[i].is_valid and value.is_valid and value.values.null_count == 0:
                x = np.floor(SCALE * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    if len(x) and np.abs(x).max() >= 2.0**62:
                        raise ValueError("components are too large for scores in 64 bits")
                    keep.append(i)
                    vecs.append(x.astype("<i8").tobytes())
                    norms.append(float(x @ x))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "label", "vec", "norm2"])


def matrix(vecs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), np.int64)
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, "<i8")
        out[i, : len(x)] = x
    return out


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """x modulo each prime, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    out = []
    for p in primes:
        r = x % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Inner products of the rows of two residue matrices, as long integers."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        r = np.zeros((len(a[k]), len(b[k])), np.int32)
        for at in range(0, a[k].shape[1], DEPTH):
            r += (a[k][:, at : at + DEPTH] @ b[k][:, at : at + DEPTH].T).astype(np.int32) % p
        r %= p
        # The next digit in the mixed radix of the primes so far.
        for d, q in zip(digits, primes):
            r = (r - d) * pow(q, -1, p) % p
        digits.append(r)
    out, unit = np.zeros(digits[0].shape, np.int64), 1
    for d, p in zip(digits, primes):
        out += d * np.int64(unit)
        unit *= p
    out[out > unit // 2] -= unit
    return out


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as give every score from -bound to bound residues of its own."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 1:
            return PRIMES[:n]
    raise ValueError("components are too large for scores in 64 bits")


class Best:
    """The first ``keep`` rows of each (anchor, place) so far: larger scores first, then smaller ids, then row numbers."""

    def __init__(self, lists: int, keep: int):
        self.keep = keep
        self.least = np.full(lists, np.iinfo(np.int64).min)
        self.at = np.empty(0, np.int64)
        self.score, self.id, self.row = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.zeros(len(self.least), bool)
        touched[at] = True
        old = touched[self.at]
        a, s, i, r = (np.concatenate([x[old], y]) for x, y in zip((self.at, self.score, self.id, self.row), (at, score, ids, rows)))
        order = np.lexsort((r, i, -s, a))
        a = a[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        order, a, rank = order[rank < self.keep], a[rank < self.keep], rank[rank < self.keep]
        full = rank == self.keep - 1
        self.least[a[full]] = s[order][full]
        self.at, self.score, self.id, self.row = (np.concatenate([x[~old], y]) for x, y in zip((self.at, self.score, self.id, self.row), (a, s[order], i[order], r[order])))


def _mine(rows: DataFrame, anchors: list, width: int, primes: tuple[int, ...], keep: int, windows: np.ndarray | None) -> DataFrame:
    """HIT rows of a block: the best of each task among the rows of the anchor's label, or of other labels in the windows.

    anchors: (vec_id, label, vec, row number); windows: (anchor, place, least, most) scores.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))  # BLOCK anchors at most

    def run(batches):
        anchors, windows = sent.value
        left = residues(matrix([a[2] for a in anchors], width), primes)
        labels, numbers = np.array([a[1] for a in anchors]), np.array([a[3] for a in anchors])
        places = 1 if windows is None else int(windows[:, 1].max(initial=0)) + 1
        none, all_of_them = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        low, high = (np.full((len(anchors), places), x) for x in ((all_of_them, none) if windows is None else (none, all_of_them)))
        if windows is not None:
            low[windows[:, 0], windows[:, 1]], high[windows[:, 0], windows[:, 1]] = windows[:, 2], windows[:, 3]
        best = Best(len(anchors) * places, keep)
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                part = batch.slice(k, PIECE)
                right = residues(matrix(part.column("vec").to_pylist(), width), primes)
                label, row = part.column("label").to_numpy(), part.column("row").to_numpy()
                ids = np.array([NO_ID if i is None else i for i in part.column("vec_id").to_pylist()], np.int64)
                for a in range(0, len(anchors), ANCHORS_AT_ONCE):
                    few = slice(a, a + ANCHORS_AT_ONCE)
                    score = scores([x[few] for x in left], right, primes)
                    same = labels[few][:, None] == label[None, :]
                    fits = same & (numbers[few][:, None] != row[None, :]) if windows is None else ~same
                    for place in range(places):
                        at = np.arange(a, a + len(score)) * places + place
                        least = np.maximum(low[few, place], best.least[at])
                        i, j = np.nonzero(fits & (score >= least[:, None]) & (score <= high[few, place][:, None]))
                        best.add(at[i], score[i, j], ids[j], row[j])
        for k in range(0, len(best.at), 1 << 14):
            at = best.at[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // places, pa.int32()), pa.array(at % places, pa.int32()), pa.array(best.row[k : k + len(at)]),
                 pa.array([None if i == NO_ID else i for i in best.id[k : k + len(at)].tolist()], pa.int64()), pa.array(best.score[k : k + len(at)])],
                names=["anchor", "place", "row", "vec_id", "score"],
            )

    return rows.mapInArrow(run, HIT)


def _first(hits: DataFrame, keep: int) -> DataFrame:
    """The first of each (anchor, place) over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _named(rows: DataFrame) -> DataFrame:
    """Whole-number vectors with a number of its own for each row."""
    packed = rows.select("vec_id", "label", "embedding").mapInArrow(whole, "vec_id long, label long, vec binary, norm2 double")
    return packed.withColumn("row", F.monotonically_increasing_id())


def hard_negatives(
    rows: DataFrame, anchors: F.Column, n_positives: int = 5, n_negatives: int = 5, least: tuple[int, int] = (80, 100), block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: (vec_id, label, embedding); anchors: which rows are anchors, a condition on vec_id and label.  A negative has
    another label and a score from least[0] / least[1] of the positive's up to the positive's.
    """
    table = cut_lineage(_named(rows))  # the numbers are fixed here
    asked = table.where(anchors)
    longest, width = table.agg(F.max("norm2"), F.max(F.octet_length("vec"))).first()
    most = asked.agg(F.max("norm2"), F.count("*")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not most[1]:
        return table.sparkSession.createDataFrame([], out)
    primes = primes_for(int((longest * most[0]) ** 0.5 * 1.000001) + 1)
    n_blocks = -(-most[1] // max(1, min(block, BLOCK_BYTES // max(1, width))))
    asked = cut_lineage(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))) if n_blocks > 1 else asked.withColumn("block", F.lit(0))
    candidates, parts, width = table.select("vec_id", "label", "vec", "row"), [], max(1, width // 8)
    for b in range(n_blocks):
        mine = [tuple(r) for r in asked.where(F.col("block") == b).select("vec_id", "label", "vec", "row").collect()]  # a block
        if not mine:
            continue
        positives = cut_lineage(_first(_mine(candidates, mine, width, primes, n_positives, None), n_positives))
        found = positives.select("anchor", F.col("rank") - 1, "score").collect()
        # The least whole score that is at least the fraction of the positive's.
        windows = np.array([(a, p, -(-least[0] * s // least[1]), s) for a, p, s in found], np.int64).reshape(-1, 4)
        hits = _first(_mine(candidates, mine, width, primes, n_negatives, windows), n_negatives)
        ids = table.sparkSession.createDataFrame([(i, m[0]) for i, m in enumerate(mine)], "anchor int, anchor_id long")
        chosen = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(hits.join(chosen, ["anchor", "place"]).join(F.broadcast(ids), "anchor").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ))
    return reduce(DataFrame.unionByName, parts)
