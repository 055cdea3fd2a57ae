"""Substring dedup on words: super-k-mer buckets.

Removes each word that is covered by a window of 50 words whose sequence also starts in a document with a
smaller id.  Consecutive windows that share a minimiser travel as one packed string to its bucket (repeats);
there words become numbers and the windows are ranked by sorting, doubling the ranked width at every sort, so
equality is exact.

Edge cases: null texts have no words; documents of fewer than 50 words lose nothing; a null id counts as
larger than any other; rows that repeat an id do not count against each other; an empty table gives an empty
result; other columns are ignored, whatever their names.  Very long texts are held whole by the task of their block, with
some 100 bytes of memory a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cloneloom.llm import repeats
from cloneloom.llm.repeats import WIDTH, U, mix

GRAM = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, GRAM, dtype=np.uint64) | U(1)


class _Hashes(dict):
    """Hash of each word, kept for words seen before."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _Hashes()


def _tokens(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), U, len(words))


def _grams(tokens: np.ndarray) -> np.ndarray:
    n = len(tokens) - GRAM + 1
    return mix(sum(tokens[i : i + n] * FACTORS[i] for i in range(GRAM)))


def _slices(block, docs, starts, stops):
    last, words = None, []
    for doc, start, stop in zip(docs, starts, stops):
        if doc != last:
            last, words = doc, block.texts[doc].split()
        yield b" ".join(words[start:stop])


def equal_windows(ids: np.ndarray) -> np.ndarray:
    """A number for each window of ids, equal for equal windows; ids: small numbers of the words."""
    rank, width = ids, 1

    def pairs(left, right):
        return np.unique(left * np.int64(right.max(initial=0) + 1) + right, return_inverse=True)[1]

    while 2 * width <= WIDTH:
        rank, width = pairs(rank[:-width], rank[width:]), 2 * width
    rest = WIDTH - width
    return pairs(rank[:-rest], rank[rest:]) if rest else rank


def first_docs(texts: list[bytes], docs: np.ndarray):
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, sizes.sum())
    n = np.maximum(sizes - WIDTH + 1, 0)
    if not n.sum():
        return np.empty(0, np.int64), n
    at = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return smallest(equal_windows(ids)[at], np.repeat(docs, n)), n


def smallest(group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document of each one's group."""
    order = np.lexsort((docs, group))
    starts = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    out = np.empty(len(docs), np.int64)
    out[order] = docs[order][starts][np.cumsum(starts) - 1]
    return out


FINDER = repeats.Finder(GRAM, _tokens, _grams, _slices, first_docs)


def _answer(block, covers) -> pa.Table:
    ids, n_words, removed, digest = [], [], [], []
    for i, cover in enumerate(covers):
        words = block.texts[i].split()
        kept = words if cover is None else [w for w, gone in zip(words, cover.tolist()) if not gone]
        ids.append(None if block.ids[i] == repeats.NO_ID else int(block.ids[i]))
        n_words.append(len(words))
        removed.append(len(words) - len(kept))
        digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return repeats.find(docs, FINDER, _answer, RESULT, hot)
