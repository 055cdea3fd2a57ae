"""Each two rows of a table by chunks: the table is packed and written once, and each two of its chunks meet in one task.

Tasks read the chunks from the shared folder (a product of partitions), so no row is sent once for each chunk that it
meets: what is written grows with the rows, and only the work with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneloom.operators.cohort import shared_dir

#: Bytes of a chunk, about, unless a single row has more; partitions that meet each other one to one, more are put together by up to eight.
CHUNK_BYTES, PARTS = 4 << 20, 24


def n_parts(rows: int, most: int) -> int:
    """Partitions for so many rows in chunks of ``most``; small tables still make some tasks."""
    return max(1, -(-rows // most), min(6, -(-rows // 256)))


def packed(rows: DataFrame, parts: int, most: int, order: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """(chunk, part, data): the rows as Arrow tables of ``most`` rows and about CHUNK_BYTES at most, written to the shared folder.

    Rows are dealt over ``parts`` partitions, by ranges of the columns of an order if one is given.  A chunk's rows have
    one value of ``by``, which is its part (a whole number; 0 without by).
    """
    dealt = rows.repartitionByRange(parts, *order) if order else rows.repartition(parts)
    sort = [by, *order] if by and by not in order else list(order)
    dealt = dealt.sortWithinPartitions(*sort) if sort else dealt

    def pieces(batch) -> Iterator[tuple[int, pa.RecordBatch]]:
        of = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)] if len(of) else [0]
        for first, end in zip(edges, edges[1:]):
            n = int(end - first)
            k = max(-(-n // most), min(n, -(-batch.nbytes * n // (len(of) * CHUNK_BYTES))))
            for i in range(k):
                yield int(of[first]), batch.slice(first + n * i // k, n * (i + 1) // k - n * i // k)

    def pack(batches) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, piece in pieces(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([base + k], pa.int64()), "part": pa.array([part], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                k += 1

    shared_dir(rows.sparkSession)
    out = dealt.mapInArrow(pack, "chunk long, part long, data binary").checkpoint(eager=True)
    made = out.rdd.getNumPartitions()
    return out.coalesce(max(PARTS, -(-made // 8))) if made > PARTS else out


def each_two(chunks: DataFrame, run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]], schema: str | T.StructType) -> DataFrame:
    """The tables that run(a, b, alone) yields for each two chunks of a part, once, and for each with itself (alone)."""
    a = chunks.select(F.col("chunk").alias("a"), F.col("part").alias("p"), F.col("data").alias("x"))
    b = chunks.select(F.col("chunk").alias("b"), F.col("part").alias("q"), F.col("data").alias("y"))

    def task(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (pa.ipc.open_stream(batch.column(c)[i].as_buffer()).read_all() for c in ("x", "y"))
                for out in run(x, y, batch.column("a")[i] == batch.column("b")[i]):
                    yield from out.to_batches()

    return a.hint("shuffle_replicate_nl").join(b, (F.col("a") <= F.col("b")) & (F.col("p") - F.col("q") == 0)).select("a", "b", "x", "y").mapInArrow(task, schema)


def each_strip(chunks: DataFrame, strips: DataFrame, run: Callable[[Iterator[dict]], Iterator[pa.Table]], schema: str | T.StructType, once: Sequence[str] = ()) -> DataFrame:
    """The tables that run yields for each partition of strips, given its chunks (a, x) with each chunk (b, y) from itself on, in the order of b.

    A task holds its own partition of strips, a bounded part of the chunks, and reads all chunks one after the other, so it can carry running
    totals from one to the next.  A strip's data and its columns ``once`` come with the first pair of it (a = b) and are null after that.
    """
    first = F.col("a") == F.col("b")
    a = strips.select(F.col("chunk").alias("a"), F.col("data").alias("x"), *once)
    b = chunks.coalesce(1).select(F.col("chunk").alias("b"), F.col("data").alias("y"))

    def task(batches) -> Iterator[pa.RecordBatch]:
        def two() -> Iterator[dict]:
            last = -1
            for batch in batches:
                for i in range(batch.num_rows):
                    now = batch.column("b")[i].as_py()
                    if now < last:
                        raise RuntimeError("chunks came out of their order")
                    last = now
                    yield {c: batch.column(c)[i] for c in batch.schema.names}

        for out in run(two()):
            yield from out.to_batches()

    met = b.hint("shuffle_replicate_nl").join(a, F.col("a") <= F.col("b"))  # the left side is read as it comes, the right one is held
    return met.select("a", "b", "y", *[F.when(first, F.col(c)).alias(c) for c in ("x", *once)]).mapInArrow(task, schema)


def ranks(table: pa.Table, key: str) -> np.ndarray:
    """Places in the order of a key without nulls, equal keys at one place."""
    return pc.rank(table.column(key), tiebreaker="dense").to_numpy()


def places(n_left: int, n_right: int, alone: bool, rank: np.ndarray, at_a_time: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, rows, low, high) of the left side's rows first .. end with all of the right side.

    rows are the pairs that count, as places in the block's matrix; low and high their rows in the two tables put together
    (the one table, if alone), low having the smaller key.  Pairs of equal keys are left out, and alone each pair comes once.
    """
    step, shift = max(1, at_a_time // max(1, n_right)), 0 if alone else n_left
    for first in range(0, n_left, step):
        end = min(n_left, first + step)
        i, j = np.repeat(np.arange(first, end), n_right), np.tile(np.arange(n_right), end - first)
        x, y = rank[i], rank[j + shift]
        rows = np.flatnonzero(x < y if alone else x != y)
        i, j, up = i[rows], j[rows] + shift, (x < y)[rows]
        yield first, end, rows, np.where(up, i, j), np.where(up, j, i)


def doubled(columns: dict[str, T.DataType]) -> T.StructType:
    """NAME1, NAME2 of each column."""
    return T.StructType([T.StructField(f"{c}{i}", kind) for c, kind in columns.items() for i in (1, 2)])


def each_side(table: pa.Table, columns: Sequence[str], low: np.ndarray, high: np.ndarray) -> dict[str, pa.ChunkedArray]:
    return {f"{c}{i}": table.column(c).take(pa.array(at)) for c in columns for i, at in ((1, low), (2, high))}
