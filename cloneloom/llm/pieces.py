"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as the protobuf that it is (pieces with scores and types, trainer and normaliser
settings), and the same tokenizer is rebuilt from tokenizers' parts: normaliser, the marker U+2581 for blanks,
unigram scores or BPE merges in the order of scores, and byte fallback.  Batches are encoded and decoded by
the library's threads, and its ids are the result.  Parity is verified for every text with the sentencepiece library;
a text on which the two differ falls back to sentencepiece's ids and is marked by parity = false, so such rows can be counted.

A BPE text is merged as a whole, as the model does.  Unigram paths are sums of scores, in single precision there and in
double precision here: two paths that tie but for rounding may be chosen differently, which parity then tells.  So may a
text that spells the name of a byte piece, such as <0x41>.  decode() uses the library's decoder, the round trip of
encode() the parsed pieces, which give the same text at a sixth of the cost.

Edge cases: null and empty texts have no tokens and decode to the empty text; very long texts are encoded
whole; a text that holds U+2581 itself decodes to a blank there, as the model defines, and round_trip tells;
repeated rows are encoded each; an empty table gives an empty result; other columns are kept, but for those
with a result's name, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Before the names of pieces that no text may match; a noncharacter.
HIDDEN = "\uffff"
#: Texts go through the libraries in groups of about so many characters.
BATCH_CHARS = 1 << 19
#: Threads of each library in a worker: a task has a core or two, and threads without work still spin.
THREADS = 2
ENCODED = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "parity": pa.bool_(), "round_trip": pa.bool_()}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size, form = (4, "<f") if wire == 5 else (8, "<d")
            yield number, struct.unpack(form, data[at : at + size])[0]
            at += size


def parse_model(data: bytes) -> dict:
    """pieces as (text, score, type), kind, byte_fallback, unk, and the normaliser's settings."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return {
        "pieces": pieces,
        "kind": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "unk": next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0),
        "charsmap": normal.get(2, b""),
        "dummy_prefix": bool(normal.get(3, 1)),
        "trim": bool(normal.get(4, 1)),
        "escape": bool(normal.get(5, 1)),
    }


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, best score first; longer parts first among equals."""
    usable = {p for p, _, kind in pieces if kind in (NORMAL, USER)}
    ways = [
        (score, len(p[:i]), len(p[i:]), p[:i], p[i:])
        for p, score, kind in pieces
        if kind in (NORMAL, USER)
        for i in range(1, len(p))
        if p[:i] in usable and p[i:] in usable
    ]
    return [(a, b) for *_, a, b in sorted(ways, key=lambda w: (-w[0], -w[1], -w[2]))]


def build(data: bytes):
    """The tokenizers.Tokenizer of a SentencePiece model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    m = parse_model(data)
    if m["kind"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m["pieces"])}
        model = models.BPE(vocab, merges(m["pieces"]), unk_token=m["pieces"][m["unk"]][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        # Texts can't spell control pieces; byte pieces keep their names, by which they are found.
        spelled = [(HIDDEN + p if kind in (CONTROL, UNKNOWN, UNUSED) else p, s) for p, s, kind in m["pieces"]]
        model = models.Unigram(spelled, unk_id=m["unk"], byte_fallback=m["byte_fallback"])
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["trim"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if m["escape"] else " "))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else []))
    return tokenizer


def piece_bytes(data: bytes) -> list[bytes]:
    """What each id stands for in a decoded text."""
    return [
        bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
        for p, _, kind in parse_model(data)["pieces"]
    ]


@lru_cache(maxsize=4)
def _codecs(path: str):
    """Both libraries' tokenizers, what each id stands for and the blanks added in front, once per worker and model."""
    import os

    import sentencepiece

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    with open(path, "rb") as file:
        data = file.read()
    return build(data), sentencepiece.SentencePieceProcessor(model_proto=data), piece_bytes(data), int(parse_model(data)["dummy_prefix"])


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encoded(path: str, texts: list[str], keep_ids: bool) -> list[pa.Array]:
    """The columns of ENCODED for one group of texts."""
    fast, exact, spelled, added = _codecs(path)
    ids, same = [], []
    for got, want in zip(fast.encode_batch_fast(texts, add_special_tokens=False), exact.encode(texts, num_threads=THREADS)):
        mine = got.ids
        same.append(mine == want)
        ids.append(mine if same[-1] else want)
    flat = np.fromiter(chain.from_iterable(ids), np.int32)
    ends = np.cumsum([0, *map(len, ids)])
    back = (b"".join(map(spelled.__getitem__, x))[added:].decode("utf-8", "replace") for x in ids)
    round_trip = [x == y for x, y in zip(texts, back)]
    digests = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends, ends[1:])]
    kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)) if keep_ids else pa.nulls(len(texts), ENCODED["ids"])
    return [kept, pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_()), pa.array(round_trip, pa.bool_())]


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """docs with ids, n_tokens, ids_sha256 (32-bit little-endian), parity and round_trip.

    A task holds the tokens of one group of texts at a time, whatever the size of its Arrow batches.
    """
    kept = [c for c in docs.columns if c not in ENCODED]
    docs = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(t.as_py() or "" for t in batch.column("text")):
                columns = batch.slice(at, len(group)).columns + _encoded(path, group, keep_ids)
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *ENCODED])

    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.StringType(), T.BooleanType(), T.BooleanType())
    added = [T.StructField(name, kind) for name, kind in zip(ENCODED, kinds)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with decoded, the text of their ids."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return pd.Series(_codecs(path)[0].decode_batch([[] if x is None else list(map(int, x)) for x in ids], skip_special_tokens=False))

    return rows.withColumn("decoded", decoded("ids"))
