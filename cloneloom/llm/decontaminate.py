"""Benchmark decontamination by an FM-index of each training shard.

A shard is some megabytes of whole documents, as a task reads them; documents are not shuffled.  Its words become the
symbols of the phrases' vocabulary, any other word and the end of a document end a stretch.  Every phrase (a window of
``WINDOW`` consecutive words of an item, or the whole item where it is shorter) is searched backwards through the ranks
of the index's wavelet matrix; occurrences are located by sampled suffix positions, and what they cover is merged to
spans of words.  Words are compared as strings by way of exact numbers, no hash takes part.

Phrases reach the tasks as a broadcast of the items of one block.  A block has at most ``block_bytes`` of items' texts
(or one item that is longer); a larger benchmark is searched block after block, each over all documents, and what they
find is merged for each document.

Words: ASCII letters and digits, A-Z in lower case, and all characters beyond ASCII.

Edge cases: null and empty texts have no words, as documents and as items; a document that is repeated, with or without
its id, gives a row each time; items that share an id count as one, items without an id as one more, named by an empty
string; an empty benchmark finds nothing; no documents give no rows; a very long document is a shard of its own; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage
from cloneloom.llm.fmindex import FMIndex

WINDOW = 10
#: Bytes of text in a shard, of benchmark texts in a block.
SHARD_BYTES, BLOCK_BYTES = 6 << 20, 2 << 20
FOUND = "doc_id long, text string, digest binary, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Lower case of letters and digits and of all beyond ASCII, blank for the rest.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """The different windows of a block of items, by length, and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        items_of: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            symbols = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if size := min(WINDOW, len(symbols)):
                rows.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(symbols, size))
                items_of.setdefault(size, []).append(np.full(len(symbols) - size + 1, number[name]))
        self.windows, self.owners = {}, {}
        for size, parts in rows.items():
            self.windows[size], which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            pair = np.unique(which.ravel() * len(self.names) + np.concatenate(items_of[size]))
            first = np.searchsorted(pair // len(self.names), np.arange(len(self.windows[size]) + 1))
            self.owners[size] = first, pair % len(self.names)


def _symbols(text: str | None, phrases: Phrases) -> np.ndarray:
    """The words as symbols, with a 0 at the end."""
    words = words_of(text)
    words.append(b"")
    return np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int32, len(words))


def _search(docs: list[np.ndarray], phrases: Phrases):
    """For each document (its symbols) with a match: its number, which of its words are covered, its items' numbers."""
    n = np.array([len(d) - 1 for d in docs], np.int64)
    start = np.cumsum(n + 1) - (n + 1)
    text = np.concatenate(docs)
    # One 0 between stretches is enough.
    kept = np.flatnonzero((text > 0) | np.concatenate([[False], text[:-1] > 0]))
    if not len(kept):
        return
    index = FMIndex(text[kept], len(phrases.vocabulary))
    cover, owned = np.zeros(len(text) + 1, np.int64), []
    for size, windows in phrases.windows.items():
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        rows = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = kept[index.locate(rows)]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        doc = np.searchsorted(start, place, side="right") - 1
        pair = np.unique(doc * len(windows) + np.repeat(hit, many))
        doc, window = pair // len(windows), pair % len(windows)
        first, items = phrases.owners[size]
        own = (first[1:] - first[:-1])[window]
        item = items[np.repeat(first[window], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
        owned.append(np.unique(np.repeat(doc, own) * len(phrases.names) + item))
    covered = np.cumsum(cover[:-1]) > 0
    pair = np.unique(np.concatenate(owned)) if owned else np.empty(0, np.int64)
    docs, at = np.unique(pair // max(1, len(phrases.names)), return_index=True)
    for doc, items in zip(docs.tolist(), np.split(pair % max(1, len(phrases.names)), at[1:])):
        yield doc, covered[start[doc] : start[doc] + n[doc]], items


def _runs(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]


def _shard(ids: list, texts: list, phrases: Phrases, digests: bool, keep_text: bool) -> pa.RecordBatch:
    symbols = [_symbols(t, phrases) for t in texts]
    spans, items = [[] for _ in ids], [[] for _ in ids]
    for doc, covered, found in _search(symbols, phrases):
        spans[doc] = _runs(covered)
        items[doc] = [phrases.names[i] for i in found]
    digest = [hashlib.sha256(b"\0" if t is None else b"\1" + t.encode("utf-8", "surrogatepass")).digest() if digests else None for t in texts]
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
    columns = (ids, texts if keep_text else [None] * len(ids), digest, [len(x) - 1 for x in symbols], spans, items)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text", "digest", "n_words", "spans", "items"])


def _found(docs: DataFrame, items: list[tuple[str, str | None]], digests: bool, keep_text: bool, shard_bytes: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)  # a block at most

    def run(batches):
        phrases, ids, texts, size = Phrases(sent.value), [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size >= shard_bytes:
                    yield _shard(ids, texts, phrases, digests, keep_text)
                    ids, texts, size = [], [], 0
        if ids:
            yield _shard(ids, texts, phrases, digests, keep_text)

    return docs.mapInArrow(run, FOUND)


def _merged(spans: F.Column) -> F.Column:
    """Sorted, overlapping and adjoining spans as one."""
    kind = "array<struct<start:int,end:int>>"
    last = lambda out: F.element_at(out, -1)
    grown = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"))))
    step = lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]), grown(out, s)).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.lit([]).cast(kind), step)


def contamination(docs: DataFrame, benchmark: DataFrame, keep_text: bool = False, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text if it is kept, n_words, spans (words start to end - 1 that a window covers), items (ids as strings, sorted), one row per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size, out = F.octet_length("text"), ["doc_id", *["text"] * keep_text, "n_words", "spans", "items"]
    blocks = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    if blocks == 1:
        return _found(docs, [tuple(r) for r in items.collect()], False, keep_text, shard_bytes).select(*out)
    # What blocks find is merged by id and text: equal rows have equal results.
    dealt = cut_lineage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    parts = [_found(docs, [tuple(r) for r in dealt.where(F.col("block") == b).select("item_id", "text").collect()], True, keep_text and b == 0, shard_bytes) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, [p.where("size(spans) > 0").select("doc_id", "digest", "spans", "items") for p in parts]).distinct()
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = parts[0].drop("spans", "items").join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(per.dtypes)[c]))
    return rows.withColumn("spans", _merged(none("spans"))).withColumn("items", none("items")).select(*out)


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """The text without its spans: what is from the first letter of a span's first word to the last of its last one goes."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is not None and len(s):
                raw = t.encode("utf-8", "surrogatepass")
                words = [m.span() for m in WORD.finditer(raw)]
                edges = [0, *(x for r in s for x in (words[r["start"]][0], words[r["end"] - 1][1])), len(raw)]
                t = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out)

    return cut(text, spans)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, text without what items cover, n_words (before), spans, items; one row per document."""
    rows = contamination(docs, benchmark, keep_text=True, **how)
    return rows.withColumn("text", without_spans(F.col("text"), F.col("spans")))
