import hashlib

import numpy as np
import pyarrow as pa
import pytest

from cloneloom.llm import repeats, substrings, suffixes


def brute(by_id, unit):
    split = (lambda t: t.encode()) if unit == "bytes" else (lambda t: t.encode().split())
    key = bytes if unit == "bytes" else tuple
    docs = {i: split(t or "") for i, t in by_id.items()}
    first = {}
    for i in sorted(docs):
        for a in range(len(docs[i]) - 49):
            first.setdefault(key(docs[i][a : a + 50]), i)
    out = {}
    for i, x in docs.items():
        gone = [False] * len(x)
        for a in range(len(x) - 49):
            if first[key(x[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        kept = [w for w, g in zip(x, gone) if not g]
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(bytes(kept) if unit == "bytes" else b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 2, repeats.HOT])
@pytest.mark.parametrize("sizes", [(6 << 20, 2 << 20), (5000, 3000)])
def test_words_and_bytes_equal_brute_force(documents, by_id, monkeypatch, hot, sizes):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(repeats, "TEXT_BYTES", sizes[1])
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", sizes[0])
    want = brute(by_id, "bytes")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(documents, hot).collect()}
    assert got == want and any(x[1] for x in want.values())
    want = {i: (a, b, d) for i, (a, b, _, d) in brute(by_id, "words").items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(documents, hot).collect()}
    assert got == want and any(x[1] for x in want.values())


def by_bucket(messages):
    column = messages.column("bucket").to_numpy()
    return [messages.filter(pa.array(column == b)) for b in np.unique(column)]


def test_long_runs_travel_as_single_windows(spark):
    """Texts of one byte or word, of different lengths: their long runs are few windows."""
    for finder, texts in ((suffixes.FINDER, ["a" * (200_000 - 7 * i) for i in range(8)]), (substrings.FINDER, ["w " * (60_000 - 7 * i) for i in range(10)])):
        rows = pa.table({"doc_id": list(range(len(texts))), "text": texts, "block": [0] * len(texts)})
        told = pa.concat_tables(repeats.shared(repeats.HOT)(part) for part in by_bucket(repeats.anchors(finder, 4)(rows)))
        sent = repeats.send(finder, 4, 64)(rows, told)
        assert sum(len(x.as_py()) for x in sent.column("data")) < 2000
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        find = suffixes.suffix_dedup if finder is suffixes.FINDER else substrings.substring_dedup
        assert sorted((r.doc_id, r.n_removed) for r in find(docs).collect()) == [(i, len(t) if finder is suffixes.FINDER else len(t.split())) if i else (0, 0) for i, t in enumerate(texts)]


def test_a_text_of_megabytes(spark):
    draw = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in draw.integers(0, 5000, 400_000))  # some 2.3 MB
    words = long.split()
    docs = spark.createDataFrame([(1, long), (2, "other words come first " * 3 + " ".join(words[1000:1200])), (3, long[5000:1_000_000])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.substring_dedup(docs).collect()}
    assert got[1] == (400_000, 0) and got[2] == (212, 200) and got[3][0] - got[3][1] <= 2
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.suffix_dedup(docs).collect()}
    assert got[1][1] == 0 and got[3] == (995_000, 995_000) and got[2][1] >= len(" ".join(words[1000:1200]))


def test_empty_null_ids_and_repeated_ids(spark, texts):
    schema = "doc_id long, text string"
    assert suffixes.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    assert substrings.substring_dedup(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (0, "short")], schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.substring_dedup(rows).collect())
    assert got == [(False, 0, 0), (False, 1, 0), (False, 1, 0), (True, 0, 80)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_spans) for r in suffixes.suffix_dedup(rows).collect())
    assert got == [(False, 0, 0, 0), (False, 1, 0, 0), (False, 1, 0, 0), (True, 0, len(long), 1)]


def test_cover_resolves_every_pair():
    for i in range(suffixes.PERIOD):
        for j in range(suffixes.PERIOD):
            d = suffixes.STEPS[i, j]
            assert {(i + d) % suffixes.PERIOD, (j + d) % suffixes.PERIOD} <= set(suffixes.COVER)


@pytest.mark.parametrize("size", [50, 1 << 16])
@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256)), b"the of and "])
def test_suffix_array_is_in_true_order(size, alphabet):
    draw = np.random.default_rng(2)
    codes = draw.choice(np.frombuffer(alphabet, np.uint8), 400)
    codes = np.concatenate([codes, codes[:155], codes, np.full(190, 97, np.uint8), codes[3:]])
    at = np.arange(len(codes) - 49)
    words = suffixes.padded(codes)
    order = np.concatenate(list(suffixes.suffix_array(words, len(codes), at, size)))
    names = [codes[i : i + 50].tobytes() for i in order]
    assert sorted(order.tolist()) == at.tolist() and names == sorted(names)
    assert suffixes.repeats_before(words, order).tolist() == [False, *(a == b for a, b in zip(names, names[1:]))]


def test_cover_ranks_are_lexicographic():
    codes = np.random.default_rng(3).choice(np.frombuffer(b"ab", np.uint8), 700)
    codes = np.concatenate([codes, codes])
    ranks = suffixes.cover_ranks(suffixes.padded(codes), len(codes))
    place = [i for i in range(len(codes) - suffixes.DEPTH) if i % suffixes.PERIOD in suffixes.COVER]
    names = [codes[i : i + suffixes.DEPTH].tobytes() for i in place]
    by = sorted(range(len(place)), key=lambda k: names[k])
    assert all((ranks[place[x]] < ranks[place[y]]) == (names[x] < names[y]) for x, y in zip(by, by[1:]))


def test_ids_beyond_the_rows_of_a_block(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(None, f"{long} {i}") for i in range(40)] + [(7, long)] * 3, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed > 0) for r in suffixes.suffix_dedup(rows).collect())
    assert got == [(False, False)] * 3 + [(True, True)] * 40
