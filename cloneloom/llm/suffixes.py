"""Suffix-array dedup on bytes: blockwise suffix sorting with a difference cover.

Removes each byte that is covered by a 50-byte string that also starts in a document with a smaller id.
Runs of text that may repeat come to Spark's text buckets as packed strings (repeats).  There the suffix array of the
bucket's text is built blockwise: splitters drawn from the suffixes' leading bytes part them into suffix buckets, which
are sorted one at a time, so that only one of them has its keys in memory.  A sort compares HEAD leading bytes; longer
ties are resolved by ranks of a difference-cover sample, computed beforehand: with D = {0, 1, 3, 9} mod 13 there is for
any two suffixes i and j a step d < 13 with i + d and j + d in the sample, whose ranks order them by the bytes from d
on.  Ties are parted by ternary quicksort, all groups of a bucket at once, so no comparison reads on through a repeat.
Equal windows are neighbours in the array; they are told by a longest common prefix of 50 bytes or more.

Edge cases: null texts are empty; documents of fewer than 50 bytes lose nothing; a null id counts as larger
than any other; rows that repeat an id do not count against each other; an empty table gives an empty result;
other columns are ignored, whatever their names.  Very long texts are held whole by the task of their block, with some 30
bytes of memory a byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloneloom.llm import repeats
from cloneloom.llm.repeats import WIDTH, U, mix

GRAM = 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Difference cover: every difference mod PERIOD is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes that a sort compares itself, and bytes that the sample's ranks stand for; WIDTH at least from any step on.
HEAD, DEPTH = 16, 4 * PERIOD
#: Suffixes of a suffix bucket, about.
SUFFIXES = 1 << 16
FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93))


def _step_table() -> np.ndarray:
    """The step d for residues i and j: (i + d) and (j + d) mod PERIOD in COVER."""
    return np.array([[next(d for d in range(PERIOD) if {(i + d) % PERIOD, (j + d) % PERIOD} <= set(COVER)) for j in range(PERIOD)] for i in range(PERIOD)])


STEPS = _step_table()


def _tokens(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _grams(codes: np.ndarray) -> np.ndarray:
    eight = leading(codes)
    n = len(codes) - GRAM + 1
    out = eight[:n] * FACTORS[0]
    out += eight[8 : 8 + n] * FACTORS[1]
    out += eight[12 : 12 + n] * FACTORS[2]
    return mix(out)


def _slices(block, docs, starts, stops):
    texts = block.texts
    return (texts[d][a:b] for d, a, b in zip(docs, starts, stops))


def leading(codes: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number; numbers are in the order of the bytes."""
    x = codes.astype(U)
    for width in (1, 2, 4):
        x = (x[:-width] << U(8 * width)) | x[width:]
    return x


def _rank(values: np.ndarray) -> np.ndarray:
    """Ranks of numbers, equal for equal ones."""
    order = np.argsort(values)
    new = values[order]
    rank = np.empty(len(order), U)
    rank[order] = np.cumsum(np.concatenate([[False], new[1:] != new[:-1]])).astype(U)
    return rank


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, which are below 2**32."""
    return _rank((left << U(32)) | right)


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the DEPTH bytes from each place of the cover, at that place; 0 elsewhere.

    words: the leading bytes of each place, at least 2 * DEPTH places beyond n.  Steps of PERIOD stay in the cover, so
    ranked widths double: 13, 26, 52.
    """
    place = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(n + DEPTH) % PERIOD])
    ranks = np.zeros(n + 2 * DEPTH, U)
    ranks[place] = _pair(_rank(words[place]), _rank(words[place + PERIOD - 8]))
    for width in (PERIOD, 2 * PERIOD):
        ranks[place] = _pair(ranks[place], ranks[place + width])
    return ranks


def _sorted_bucket(at: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The suffixes that start in ``at``, sorted."""
    first, second = words[at], words[at + 8]
    order = np.lexsort((second, first))
    at, first, second = at[order], first[order], second[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    out, where = at.copy(), np.arange(len(at))
    while True:
        # Only groups of two or more go on, each in its own stretch of places.
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(at)))
        group = np.repeat(np.arange(len(starts)), size)
        go = (size > 1)[group]
        if not go.any():
            return out
        pivot = at[(starts + size // 2)][group]
        at, where, group, pivot = at[go], where[go], group[go], pivot[go]
        step = STEPS[at % PERIOD, pivot % PERIOD]
        a, b = ranks[at + step], ranks[pivot + step]
        side = (a > b).astype(np.int64) - (a < b)
        key = 3 * group + side
        order = np.argsort(key, kind="stable")
        at, key, side = at[order], key[order], side[order]
        out[where] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        unequal = side != 0
        at, where, new = at[unequal], where[unequal], new[unequal]


def padded(codes: np.ndarray) -> np.ndarray:
    """The leading bytes of every place, and of some beyond the end."""
    return leading(np.concatenate([codes, np.zeros(3 * DEPTH, np.uint8)]))


def suffix_array(words: np.ndarray, n: int, at: np.ndarray, size: int = SUFFIXES) -> Iterator[np.ndarray]:
    """The suffixes of a text of n bytes that start in ``at`` in lexicographic order (of WIDTH bytes at least), a suffix bucket at a time."""
    ranks = cover_ranks(words, n)
    count = max(1, -(-len(at) // size))
    sample = np.sort(words[at[:: max(1, len(at) // (32 * count))]])
    splitters = np.unique(sample[len(sample) * np.arange(1, count) // count])
    bucket = np.searchsorted(splitters, words[at], side="right")
    order = np.argsort(bucket.astype(np.uint16) if count < 1 << 16 else bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=len(splitters) + 1))
    for start, end in zip(ends - np.diff(ends, prepend=0), ends):
        if end > start:
            yield _sorted_bucket(at[order[start:end]], words, ranks)


def repeats_before(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each sorted suffix has WIDTH bytes in common with the one before it."""
    same = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for k in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        left = left[words[order[left] + k] == words[order[left - 1] + k]]
    same[left] = True
    return same


def first_docs(texts: list[bytes], docs: np.ndarray):
    """See repeats.text_bucket."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = np.maximum(sizes - WIDTH + 1, 0)
    if not n.sum():
        return np.empty(0, np.int64), n
    owner = np.repeat(np.arange(len(texts)), n)
    at = (np.cumsum(sizes) - sizes)[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    codes = np.frombuffer(b"".join(texts), np.uint8)
    own, words = np.zeros(len(codes), np.int64), padded(codes)
    own[at] = docs[owner]
    for order in suffix_array(words, len(codes), at):
        starts = np.flatnonzero(~repeats_before(words, order))
        least = np.minimum.reduceat(own[order], starts)
        own[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return own[at], n


FINDER = repeats.Finder(GRAM, _tokens, _grams, _slices, first_docs)


def _answer(block, covers) -> pa.Table:
    rows = []
    for i, cover in enumerate(covers):
        text = block.texts[i]
        removed = spans = 0
        if cover is not None:
            removed = int(cover.sum())
            spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
            text = block.tokens[i][~cover].tobytes()
        rows.append((None if block.ids[i] == repeats.NO_ID else int(block.ids[i]), len(block.texts[i]), removed, spans, hashlib.sha256(text).hexdigest()))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=names)


def suffix_dedup(docs: DataFrame, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats.find(docs, FINDER, _answer, RESULT, hot)
