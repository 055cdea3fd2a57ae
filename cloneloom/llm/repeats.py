"""Shared skeleton of the two repeat finders (bytes and words): blocks of documents and buckets of text.

A window is ``WIDTH`` consecutive tokens of one document.  Each window is named by its minimiser, the least
hash among its token grams; consecutive windows with one minimiser form a run.

1. Documents are dealt into blocks by their id and text.  A block sends the minimisers of its runs, as packed sorted
   numbers, to the minimisers' buckets.
2. A bucket tells each block which of its minimisers occur in two documents or more: no other run can hold a
   repeated window.
3. A block sends every different run with such a minimiser, once and with its smallest document, as a packed
   string to the minimiser's text bucket.  Runs of a minimiser that is ``hot`` (in very many documents, or with very
   long runs) are sent as single windows, dealt by their own content: no key holds more than its different windows, and a
   block sends each of those once.
4. A text bucket finds equal windows exactly (the part in which the finders differ) and answers with the
   smallest document of each window.
5. A block marks what its documents lose.

All steps are one lazy plan; the shuffle of the documents into blocks is made once and reused.  The number of
blocks and buckets follows the bytes of text, so tasks stay of one size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 50
BLOCK_BYTES, ANCHOR_BYTES, TEXT_BYTES = 6 << 20, 16 << 20, 2 << 20
#: Documents of a minimiser, and tokens of its runs, beyond which its windows travel singly.  Tokens are counted from
#: LONG of them in a block on, so what is not counted is under HOT x LONG.  Long runs repeat a few windows many times.
HOT, HOT_TOKENS, LONG = 4000, 1 << 19, 1024
#: Tokens that are hashed at a time; small, so that the arrays stay in a core's cache.
PIECE = 1 << 15
U = np.uint64
NO_ID = np.iinfo(np.int64).max
MESSAGE = "block long, bucket long, kind int, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    low, n = a, 1
    while 2 * n <= width:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    return np.minimum(low[: len(low) - (width - n)], low[width - n :]) if width > n else low


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob."""
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], dtype=np.int64).tobytes()
    raw = b"".join([head, *(np.ascontiguousarray(x).tobytes() for x in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, dtype in zip(sizes, dtypes):
        out.append(np.frombuffer(raw, dtype, int(size) // np.dtype(dtype).itemsize, at))
        at += int(size)
    return out


@dataclass
class Finder:
    """What differs between the finders.

    tokens: text -> token hashes or codes; grams: their gram hashes (gram tokens each); slices: the string of
    tokens [start, stop) of a text; first_docs: see text_bucket.
    """

    gram: int
    tokens: Callable
    grams: Callable
    slices: Callable
    first_docs: Callable


@dataclass
class Runs:
    """Runs of a block: minimiser, document (index), first token in it, number of windows; content of each window by route()."""

    mini: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    route: list


class Block:
    """The documents of a block in the order of their ids, and the runs in them."""

    def __init__(self, rows: pa.Table, finder: Finder):
        ids = rows.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in order], dtype=np.int64)
        self.texts = [texts[i] for i in order]
        self.tokens = [finder.tokens(t) for t in self.texts]
        self.finder = finder
        self.runs = self._runs()

    def _runs(self) -> Runs:
        out, group, size = [], [], 0
        for i, t in enumerate(self.tokens):
            if len(t) >= WIDTH:
                group.append(i)
                size += len(t)
            if group and (size > PIECE or i == len(self.tokens) - 1):
                out.append(self._piece(group))
                group, size = [], 0
        if group:
            out.append(self._piece(group))
        if not out:
            return Runs(np.empty(0, U), *(np.empty(0, np.int64) for _ in range(3)), [])
        return Runs(*(np.concatenate([x[i] for x in out]) for i in range(4)), np.concatenate([x[4] for x in out]))

    def _piece(self, group: list[int]):
        sizes = np.array([len(self.tokens[i]) for i in group])
        ends = np.cumsum(sizes)
        first = ends - sizes
        gram = self.finder.grams(np.concatenate([self.tokens[i] for i in group]))
        low = sliding_min(gram, WIDTH - self.finder.gram + 1)
        change = np.flatnonzero(low[1:] != low[:-1]) + 1
        cut = np.union1d(change, first)
        owner = np.searchsorted(first, cut, side="right") - 1
        # A run ends where the next begins or where its document has no further window.
        n = np.minimum(np.append(cut[1:], len(low)), ends[owner] - WIDTH + 1) - cut
        cut, n, owner = cut[n > 0], n[n > 0], owner[n > 0]
        # A cheap name of a single window, for dealing: its first and last gram.
        name = mix(gram[cut] * U(3) + mix(gram[cut + n - 1 + WIDTH - self.finder.gram]))
        return low[cut], np.array(group)[owner], cut - first[owner], n, name

    def strings(self, known: np.ndarray, hot: np.ndarray):
        """Runs with a known minimiser as (doc, start, n, minimiser or name); hot ones in single windows."""
        r = self.runs
        keep = np.flatnonzero(np.isin(r.mini, known)) if len(known) else np.empty(0, np.int64)
        doc, start, n, key = r.doc[keep], r.start[keep], r.n[keep], r.mini[keep]
        single = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        if single.any():
            many = n[single]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            d, s = np.repeat(doc[single], many), np.repeat(start[single], many) + step
            names = np.empty(len(d), U)
            for i in np.unique(d):
                at = np.flatnonzero(d == i)
                gram = self.finder.grams(self.tokens[i])
                names[at] = mix(gram[s[at]] * U(3) + mix(gram[s[at] + WIDTH - self.finder.gram]))
            doc, start = np.concatenate([doc[~single], d]), np.concatenate([start[~single], s])
            n, key = np.concatenate([n[~single], np.ones(len(d), np.int64)]), np.concatenate([key[~single], names])
            order = np.lexsort((start, doc))
            doc, start, n, key = doc[order], start[order], n[order], key[order]
        return doc, start, n, key

    def distinct(self, known, hot, buckets: int):
        """The runs of strings(), the number of each one's string, and of each string: bucket, text, first doc, windows."""
        doc, start, n, key = self.strings(known, hot)
        seen: dict[bytes, int] = {}
        texts = self.finder.slices(self, doc.tolist(), start.tolist(), (start + n + WIDTH - 1).tolist())
        number = np.fromiter((seen.setdefault(t, len(seen)) for t in texts), np.int64, len(doc))
        _, first = np.unique(number, return_index=True)
        return doc, start, n, number, bucket_of(key[first], buckets), list(seen), self.ids[doc[first]], n[first]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "bucket", "kind", "data"])


def _by(keys: np.ndarray):
    """(key, where it is) for each different key."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1 if len(keys) else []
    at = 0
    for end in ends:
        yield int(keys[order[at]]), order[at:end]
        at = end


def anchors(finder: Finder, buckets: int):
    """Step 1: kind 0, the minimisers of a block for a bucket: sorted, with their numbers of documents and of many tokens."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows, finder)
        if not len(block.runs.mini):
            return _messages([])
        order = np.argsort(block.runs.mini, kind="stable")  # within a minimiser the documents stay in order
        mini, doc = block.runs.mini[order], block.ids[block.runs.doc[order]]
        new = np.concatenate([[True], mini[1:] != mini[:-1]])
        other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        starts = np.flatnonzero(new)
        tokens = np.add.reduceat(block.runs.n[order] + WIDTH - 1, starts)
        mini, count = mini[starts], np.add.reduceat(other.astype(np.int64), starts)
        number = rows.column("block")[0].as_py()
        out = []
        for bucket, at in _by(bucket_of(mini, buckets)):
            more, long = np.flatnonzero(count[at] > 1), np.flatnonzero(tokens[at] >= LONG)
            names = (mini[at] & U(0xFFFFFFFF)).astype(np.uint32)
            out.append((number, bucket, 0, pack(names, more.astype(np.uint32), count[at][more].astype(np.uint32), long.astype(np.uint32), tokens[at][long])))
        return _messages(out)

    return run


def _anchor_lists(blob: bytes):
    low, more, many, long, sizes = unpack(blob, np.uint32, np.uint32, np.uint32, np.uint32, np.int64)
    count, tokens = np.ones(len(low), np.int64), np.zeros(len(low), np.int64)
    count[more], tokens[long] = many, sizes
    return low, count, tokens


def shared(hot: int):
    """Step 2: kind 1, the minimisers of a block that are in two documents or more, the hot ones apart."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        lists = [_anchor_lists(x.as_py()) for x in rows.column("data")]
        _, which = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total, tokens = (np.bincount(which, weights=np.concatenate([x[k] for x in lists])) for k in (1, 2))
        single = (total > hot) | (tokens > HOT_TOKENS)
        out, at = [], 0
        for block, (low, *_) in zip(rows.column("block").to_pylist(), lists):
            mine = which[at : at + len(low)]
            at += len(low)
            many, alone = total[mine] > 1, single[mine]
            if many.any():
                out.append((block, bucket, 1, pack(low[many & ~alone], low[many & alone])))
        return _messages(out)

    return run


def _known(block: Block, told: pa.Table, buckets: int):
    """The block's shared minimisers and the hot ones among them."""
    mini = np.unique(block.runs.mini)
    place = (bucket_of(mini, buckets).astype(U) << U(32)) | (mini & U(0xFFFFFFFF))
    plain, hot = [], []
    for bucket, kind, data in zip(told.column("bucket").to_pylist(), told.column("kind").to_pylist(), told.column("data")):
        if kind == 1:
            a, b = unpack(data.as_py(), np.uint32, np.uint32)
            plain.append(a.astype(U) | U(bucket << 32))
            hot.append(b.astype(U) | U(bucket << 32))
    if not plain:
        return np.empty(0, U), np.empty(0, U)
    plain, hot = np.concatenate(plain), np.concatenate(hot)
    is_hot = np.isin(place, hot)
    return mini[np.isin(place, plain) | is_hot], mini[is_hot]


def send(finder: Finder, buckets: int, text_buckets: int):
    """Step 3: kind 2, the different strings of a block for a text bucket, with their first documents."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _messages([])
        block = Block(rows, finder)
        _, _, _, _, home, texts, first, _ = block.distinct(*_known(block, told, buckets), text_buckets)
        number = rows.column("block")[0].as_py()
        return _messages([
            (number, bucket, 2, pack(np.array([len(texts[i]) for i in at], np.uint32), first[at], np.frombuffer(b"".join(texts[i] for i in at), np.uint8)))
            for bucket, at in _by(home)
        ])

    return run


def text_bucket(finder: Finder):
    """Step 4: kind 3, the first documents of the windows of a block's strings where they are not the string's own.

    finder.first_docs(texts, docs) gives, for different strings and the first document of each, one array of the
    smallest document of every window, string after string, and the number of windows of each.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket, seen, least, sent = rows.column("bucket")[0].as_py(), {}, [], []
        for data in rows.column("data"):
            sizes, first, text = unpack(data.as_py(), np.uint32, np.int64, np.uint8)
            raw, at, numbers = text.tobytes(), 0, []
            for size, doc in zip(sizes.tolist(), first.tolist()):
                i = seen.setdefault(raw[at : at + size], len(seen))
                at += size
                if i == len(least):
                    least.append(doc)
                elif doc < least[i]:
                    least[i] = doc
                numbers.append(i)
            sent.append((np.array(numbers), first))
        docs, n = finder.first_docs(list(seen), np.array(least, np.int64))
        offset = np.cumsum(n) - n
        out = []
        for block, (numbers, first) in zip(rows.column("block").to_pylist(), sent):
            many = n[numbers]
            string = np.repeat(np.arange(len(numbers)), many)
            window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            got = docs[np.repeat(offset[numbers], many) + window]
            starts = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1]) | (string[1:] != string[:-1])])) if len(got) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(got))
            tell = got[starts] != first[string[starts]]
            starts, ends = starts[tell], ends[tell]
            if len(starts):
                out.append((block, bucket, 3, pack(string[starts].astype(np.uint32), window[starts].astype(np.uint32), (ends - starts).astype(np.uint32), got[starts])))
        return _messages(out)

    return run


def marked(rows: pa.Table, told: pa.Table, finder: Finder, buckets: int, text_buckets: int):
    """Step 5: the block, and for each of its documents which tokens are covered."""
    block = Block(rows, finder)
    doc, start, n, number, home, texts, first, windows = block.distinct(*_known(block, told, buckets), text_buckets)
    least, offset = np.repeat(first, windows), np.cumsum(windows) - windows
    place = dict(_by(home))
    for bucket, kind, data in zip(told.column("bucket").to_pylist(), told.column("kind").to_pylist(), told.column("data")):
        if kind == 3:
            string, window, many, got = unpack(data.as_py(), np.uint32, np.uint32, np.uint32, np.int64)
            at, many = offset[place[bucket][string]] + window.astype(np.int64), many.astype(np.int64)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            least[np.repeat(at, many) + step] = np.repeat(got, many)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = least[np.repeat(offset[number], n) + step] < np.repeat(block.ids[doc], n)
    who, where = np.repeat(doc, n)[gone], (np.repeat(start, n) + step)[gone]
    covers = [None] * len(block.ids)
    for i, at in _by(who):
        begins = np.zeros(len(block.tokens[i]), np.int32)
        begins[where[at]] = 1
        begins = np.cumsum(begins, dtype=np.int32)
        begins[WIDTH:] -= begins[:-WIDTH].copy()  # windows that begin in the last WIDTH places
        covers[i] = begins > 0
    return block, covers


def find(docs: DataFrame, finder: Finder, answer: Callable, schema: str, hot: int = HOT) -> DataFrame:
    """answer(block, covers) -> table, over all blocks of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets, text_buckets = (max(1, -(-total // size)) for size in (BLOCK_BYTES, ANCHOR_BYTES, TEXT_BYTES))
    # Rows of one id, or none, need not meet: a window is only removed for an id that is smaller.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInArrow(anchors(finder, buckets), MESSAGE)
    known = sent.groupBy("bucket").applyInArrow(shared(hot), MESSAGE)
    strings = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send(finder, buckets, text_buckets), MESSAGE)
    answers = strings.groupBy("bucket").applyInArrow(text_bucket(finder), MESSAGE)

    def last(rows: pa.Table, told: pa.Table) -> pa.Table:
        return answer(*(marked(rows, told, finder, buckets, text_buckets) if rows.num_rows else (None, [])))

    return dealt.groupBy("block").cogroup(known.unionByName(answers).groupBy("block")).applyInArrow(last, schema)
