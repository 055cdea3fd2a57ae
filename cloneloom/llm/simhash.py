"""SimHash near-duplicates with pivot distance tables.

Fingerprint: one bit is set if it is set in over half of the XXH64 hashes (seed 42) of the 3-word shingles of
the lower-cased (A-Z) text, repeats included.  Documents link at 3 or fewer differing bits.

Search: equal fingerprints are one class, named by the fingerprint.  Two fingerprints that differ in at
most 3 bits agree in at least 3 of 6 blocks, so every linked pair meets under one of the 20 choices of 3
blocks.  Rows that share such a key are sorted by their Hamming distance to the first pivot (a reference
fingerprint); a sweep over that column takes the pairs within 3 of each other, the largest difference over
the other pivots' distances discards most of the rest (the triangle inequality: no true link is lost), and
the survivors are verified bit by bit.  A key with more than ``chunk`` classes is dealt over pairs of chunks.
Each task gives back stars instead of pairs, and components joins them.

Edge cases: null texts are empty; a text without words has fingerprint zero and is linked like any other;
fewer than 3 words are one shingle; very long texts are hashed whole, with some 100 bytes of memory a word; repeated ids stay
separate rows, each in the class of its text; null ids count as larger than any other, and a component that has no other has
a null component_id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage
from cloneloom.llm.components import components, local_stars

SEED, SHINGLE, NEAR = 42, 3, 3
#: Widths of the 6 blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
N_PIVOTS = 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def masks() -> list[int]:
    """The bits that each choice of 3 blocks compares."""
    starts = np.cumsum((0, *BLOCKS))[:-1]
    bits = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts)]
    return [a | b | c for a, b, c in combinations(bits, 3)]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        ends = (ends - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])]
    array = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(array), 4096):
        part = np.unpackbits(array[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(array), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: F.Column) -> F.Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""
    return docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp"))


def _near_pairs(group: np.ndarray, fp: np.ndarray, table: np.ndarray, side: np.ndarray):
    """Index pairs of one group at most NEAR bits apart; table: distances to the pivots, a row each.

    side is 0 for a group that is compared with itself, else 1 and 2 for the two chunks that are compared.
    """
    order = np.lexsort((table[:, 0], group))
    group, fp, table, side = group[order], fp[order], table[order], side[order]
    at, lag, found = np.arange(len(order)), 0, []
    while len(at):
        lag += 1
        at = at[at + lag < len(order)]
        other = at + lag
        go = (group[at] == group[other]) & (table[other, 0].astype(np.int16) - table[at, 0] <= NEAR)
        at, other = at[go], other[go]
        x, y = at, other
        mixed = (side[x] != side[y]) | (side[x] == 0)
        x, y = x[mixed], y[mixed]
        for p in range(1, table.shape[1]):
            close = np.abs(table[x, p].astype(np.int16) - table[y, p]) <= NEAR
            x, y = x[close], y[close]
        true = np.bitwise_count(fp[x] ^ fp[y]) <= NEAR
        found.append((order[x[true]], order[y[true]]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _whole_groups(batches):
    """Sorted batches as tables that hold whole groups (column task)."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        task = now.column("task").to_numpy()
        cut = int(np.searchsorted(task, task[-1], side="left")) if len(task) else 0
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _link(batches):
    reference = pivots()
    for rows in _whole_groups(batches):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        table = np.bitwise_count(fp[:, None] ^ reference[None, :])
        # Two keys whose task hashes collide only add pairs to verify.
        x, y = _near_pairs(rows.column("task").to_numpy(), fp, table, rows.column("side").to_numpy())
        rep = rows.column("rep").to_numpy()
        a, b = local_stars(rep[x], rep[y])
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_pydict({"a": a[i : i + (1 << 16)], "b": b[i : i + (1 << 16)]})


def near_links(classes: DataFrame, chunk: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of classes (fp, rep) at most NEAR bits apart."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks()]
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    # Each class becomes 20 rows: tasks are sized before that, so the classes are dealt over all of them first.
    dealt = classes.select("fp", "rep").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = dealt.select("fp", "rep", F.explode(choices).alias("c")).select("fp", "rep", "c.choice", "c.key")
    counts = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(counts, ["choice", "key"]).withColumn("m", F.ceil(F.col("n") / chunk).cast("int"))
    shared = shared.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda t: F.struct(
            F.least(t, F.col("c")).alias("i"), F.greatest(t, F.col("c")).alias("j"),
            F.when(t == F.col("c"), 0).when(F.col("c") < t, 1).otherwise(2).alias("side"),
        ),
    )
    tasks = shared.select("fp", "rep", "choice", "key", F.explode(pairs).alias("p")).select(
        "fp", "rep", "p.side", F.xxhash64("choice", "key", "p.i", "p.j").alias("task")
    )
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_link, "a long, b long")


def with_components(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp and others) with component_id, the smallest id of the component, and component, its smallest fingerprint."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("least")))
    linked = components(near_links(classes.select("fp", F.col("fp").alias("rep"))))
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that a document reaches by links, its own included."""
    return with_components(cut_lineage(fingerprints(docs))).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id (a row without one comes last).

    Rows that repeat the id are told apart by fingerprint, text and all columns; of equal rows one stays.
    """
    marks = {"_mark": F.md5(F.col("text").cast("binary")), "_row": F.xxhash64(*docs.columns)}
    rows = docs.withColumns(marks)
    prints = cut_lineage(rows.select("doc_id", "_mark", "_row", fingerprint_of(F.col("text")).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "_mark", "_row")
    leaders = with_components(prints).groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first._mark", "first._row")
    leaders = leaders.withColumnsRenamed({c: f"of{c}" for c in leaders.columns})
    same = F.col("doc_id").eqNullSafe(F.col("ofdoc_id")) & F.col("_mark").eqNullSafe(F.col("of_mark")) & (F.col("_row") == F.col("of_row"))
    return rows.join(leaders, same, "left_semi").dropDuplicates(["doc_id", "_mark", "_row"]).select(*docs.columns)
