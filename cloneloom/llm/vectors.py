"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= c are at most r = sqrt(2 - 2c) apart.  Pivots split the space: the home cell of a
vector is that of its nearest pivot.  If two vectors of different cells i and j are within r, the segment
between them crosses the plane half-way between the pivots, so each lies within r of that plane: of two cells
only the vectors that near to the plane between them are compared.  Vectors are sorted by cell and packed in
chunks, written once; each two chunks meet in a task that reads them from there, so no vector is copied to the
cells around and no task holds more than two chunks whatever the data are.  A task gives back a count for each
vector with links and stars instead of pairs.

Equal vectors are one class with a multiplicity before the join.  The number of pivots grows with the number
of classes up to MAX_PIVOTS; only pivots reach the driver.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors
link only with others of their length; rows with a null id link with nothing; a repeated id counts as
separate vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage
from cloneloom.llm.components import components, local_stars
from cloneloom.products import CHUNK_BYTES, each_two, packed

MAX_PIVOTS, PER_CELL = 1024, 3000
#: Vectors of a chunk at most; those that are compared at a time; candidates of such a block from which on it is multiplied in double precision.
HOME_CHUNK, OTHER_CHUNK, BLOCK, DENSE = 8192, 4096, 512, 1 << 16
SLACK = 1e-9
#: More than the rounding of a squared distance that is taken from products.
ROUNDING = 1e-12
CLASS = "cell long, digest binary, rep long, mult long, vec binary"


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """vec_id, digest, vec: the components as little-endian doubles, null where they can't be compared."""
    for batch in batches:
        ids, vecs, digests = batch.column("vec_id"), [], []
        for i, value in zip(ids, batch.column("embedding")):
            vec = None
            if i.is_valid and value.is_valid and len(value) and value.values.null_count == 0:
                array = value.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(array).all() and array.any():
                    vec = (array / np.abs(array).max() if np.abs(array).max() > 1e100 or np.abs(array).max() < 1e-100 else array).tobytes()
            vecs.append(vec)
            digests.append(None if vec is None else hashlib.blake2b(vec, digest_size=16).digest())
        yield pa.RecordBatch.from_pydict({"vec_id": ids.cast(pa.int64()), "digest": pa.array(digests, pa.binary()), "vec": pa.array(vecs, pa.binary())})


def _units(vecs: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: where the vectors of that length are, and they themselves at length 1."""
    sizes = np.array([len(v.as_buffer()) for v in vecs], dtype=np.int64)
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(vecs[int(i)].as_py() for i in at), dtype="<f8").reshape(len(at), -1)
        out[int(size) // 8] = at, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _apart(pivots: np.ndarray) -> np.ndarray:
    """Distances of unit pivots from their products, none of them too small."""
    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0) + ROUNDING)


def _cells(x: np.ndarray, pivots: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and for each cell whether the vector is in it (home or near its border)."""
    home, member = np.empty(len(x), np.int64), np.empty((len(x), len(pivots)), bool)
    for k in range(0, len(x), BLOCK):
        near = x[k : k + BLOCK] @ pivots.T
        own = near.argmax(axis=1)
        gap = near[np.arange(len(near)), own][:, None] - near
        home[k : k + BLOCK], member[k : k + BLOCK] = own, gap <= (radius + SLACK) * apart[own] + SLACK
    return home, member


def _homes(batches, pivots: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of CLASS: vectors with their home cell, -length where their length has no pivot.

    pivots: by length of vector, the number of its first cell and its pivots.
    """
    for batch in batches:
        cell = np.empty(batch.num_rows, np.int64)
        for dim, (at, x) in _units(batch.column("vec")).items():
            first, p = pivots.get(dim, (-dim, None))
            cell[at] = first
            for k in range(0, len(at) if p is not None else 0, BLOCK):
                cell[at[k : k + BLOCK]] += (x[k : k + BLOCK] @ p.T).argmax(axis=1)
        yield pa.RecordBatch.from_pydict({"cell": cell, **{c: batch.column(c) for c in ("digest", "rep", "mult", "vec")}})


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the unit vectors with at least this cosine: by products in single precision with room for their rounding, then exactly."""
    room = 1.2e-7 * (x.shape[1] + 4)
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(cosine - room))
    if len(i) > DENSE:
        return np.nonzero(x @ y.T >= cosine)
    sure = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return i[sure], j[sure]


def _join(cosine: float, pivots: dict[int, tuple[int, np.ndarray]]):
    radius = math.sqrt(2 - 2 * cosine)

    def join(a: pa.Table, b: pa.Table, alone: bool) -> Iterator[pa.Table]:
        sides = []
        for t in (a, b):
            columns = {c: t.column(c).to_numpy() for c in ("cell", "rep", "mult")}
            sides.append((columns, _units(t.column("vec").combine_chunks()), np.zeros(t.num_rows, np.int64)))
        (left, mine, n_left), (right, others, n_right) = sides
        stars = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for dim in mine.keys() & others.keys():
            (at, x), (to, y) = mine[dim], others[dim]
            first, p = pivots.get(dim, (-dim, None))
            for i in np.unique(left["cell"][at]):
                for j in np.unique(right["cell"][to]):
                    if alone and j < i:
                        continue
                    u, v = np.flatnonzero(left["cell"][at] == i), np.flatnonzero(right["cell"][to] == j)
                    if i != j:  # only those within the radius of the plane between the cells
                        between = p[i - first] - p[j - first]
                        reach = (radius + SLACK) * float(_apart(p[[i - first, j - first]])[0, 1]) + SLACK
                        u, v = u[x[u] @ between <= reach], v[y[v] @ -between <= reach]
                    for k in range(0, len(u), BLOCK):
                        for m in range(0, len(v), OTHER_CHUNK):
                            s, t = _linked(x[u[k : k + BLOCK]], y[v[m : m + OTHER_CHUNK]], cosine)
                            s, t = at[u[k + s]], to[v[m + t]]
                            if alone and i == j:
                                s, t = s[s < t], t[s < t]
                            if not len(s):
                                continue
                            n_left += np.bincount(s, right["mult"][t], len(n_left)).astype(np.int64)
                            n_right += np.bincount(t, left["mult"][s], len(n_right)).astype(np.int64)
                            stars.append(local_stars(left["rep"][s], right["rep"][t]))
        s, t = local_stars(*map(np.concatenate, zip(*stars)))
        nothing = lambda k: pa.nulls(k, pa.int64())
        yield pa.table({"digest": pa.nulls(len(s), pa.binary()), "a": pa.array(s, pa.int64()), "b": pa.array(t, pa.int64()), "n": nothing(len(s))})
        for table, n in ((a, n_left), (b, n_right)):
            some = np.flatnonzero(n)
            yield pa.table({"digest": table.column("digest").take(pa.array(some)), "a": nothing(len(some)), "b": nothing(len(some)), "n": n[some]})

    return join


def near_vectors(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id for rows of (vec_id, embedding)."""
    known = cut_lineage(rows.select("vec_id", "embedding").mapInArrow(_packed, "vec_id long, digest binary, vec binary"))
    classes = known.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    classes = cut_lineage(classes)
    n_classes = classes.count()
    wanted = min(MAX_PIVOTS, -(-n_classes // PER_CELL))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vec").toArrow().column("vec").combine_chunks()
    pivots, first = {}, 0
    for dim, (_, x) in (_units(chosen) if len(chosen) else {}).items():
        pivots[dim] = first, x
        first += len(x)
    size = classes.agg(F.sum(F.octet_length("vec"))).first()[0] or 0
    parts = max(1, -(-size // (CHUNK_BYTES * 3 // 4)), min(12, -(-n_classes // 1024)))
    homes = classes.mapInArrow(lambda it: _homes(it, pivots), CLASS)
    chunks = packed(homes, parts, HOME_CHUNK, ("cell", "rep"))
    found = cut_lineage(each_two(chunks, _join(cosine, pivots), "digest binary, a long, b long, n long"))
    counts = found.where("n is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    linked = components(found.where("n is null").select("a", "b")).withColumnRenamed("node", "rep")
    ends = classes.select("digest", "rep", "mult").join(counts, "digest", "left").join(linked, "rep", "left")
    ends = ends.select("digest", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return known.select("vec_id", "digest").join(ends, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
