"""Decontamination, hard negatives and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.llm import decontaminate, fmindex, negatives, prefixes, queries
from tests.oracle import difference


@pytest.mark.parametrize("symbols,n", [(1, 40), (2, 300), (9, 2000), (300, 5000)])
def test_index_finds_and_locates_all(symbols, n):
    draw = np.random.default_rng(symbols)
    text = draw.integers(0, symbols + 1, n) * (draw.random(n) > 0.05)
    text = np.append(np.concatenate([text, text[: n // 3], text[5:25].repeat(3), np.full(50, symbols)]), 0)
    index = fmindex.FMIndex(text, symbols)
    for size in (1, 2, 3, 7, 12):
        starts = draw.integers(0, len(text) - size, 60)
        phrases = [text[s : s + size] for s in starts] + [draw.integers(1, symbols + 1, size) for _ in range(20)]
        phrases = np.array([p for p in phrases if (p > 0).all()]).reshape(-1, size)
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order():
    draw = np.random.default_rng(5)
    text = np.append(draw.integers(0, 3, 400), 0)
    text = np.concatenate([text, text])
    zeros = np.cumsum(text == 0)

    def key(i):
        out = []
        for k in range(i, len(text)):
            out.append((0, int(zeros[k])) if text[k] == 0 else (1, int(text[k])))
            if text[k] == 0:
                return out

    assert fmindex.suffix_array(text).tolist() == sorted(range(len(text)), key=key)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(str(name) if name is not None else "")
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    found |= own
                    hit |= set(range(i, i + size))
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def leaky():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["élan", "x9", "Zu"]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.choice([3, 9, 10, 11, 40]))) for i in range(30)] + [(7, say(12)), (None, say(14)), (50, None), (51, "  ., "), (52, "Lone"), (53, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    items.append((54, items[2][1]))
    docs = [(i, say(draw.choice([0, 1, 8, 60, 200]))) for i in range(80)]
    for k in range(60):
        w = words(items[k % len(items)][1])
        cut = draw.choice([0, 0, 1, 3])
        docs.append((100 + k, f"{say(5)}; {'-'.join(w[cut:]).upper()}! {say(9)}"))
    docs += [(None, None), (None, "lone"), (3, docs[110][1]), (3, docs[110][1]), (200, "w1 " * 500), (201, say(60000) + " " + items[4][1] * 2), (202, "LONE,lone lonely")]
    return docs, items


@pytest.mark.parametrize("shard,block", [(200, 1 << 20), (6 << 20, 300), (3000, 1500)])
def test_contamination_equals_brute_force(spark, leaky, shard, block):
    docs, items = leaky
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    rows = decontaminate.contamination(df, bench, shard_bytes=shard, block_bytes=block).collect()
    got = sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in rows), key=str)
    assert got == sorted(brute_contamination(docs, items), key=str)
    for r in rows:  # merged: no span touches the next
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_removal_keeps_the_rest_as_it_is(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before, this:  {phrase.upper()}! After\n"), (2, "clean  text."), (3, None), (4, f"{phrase} eleven {phrase}")]
    rows = decontaminate.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "Before, this:  ! After\n", 2: "clean  text.", 3: None, 4: " eleven "}


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    rows = decontaminate.contamination(spark.createDataFrame([(1, "a b c")], none.schema), bench.limit(0)).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in rows] == [(3, [], [])]


def test_scores_are_exact():
    draw = np.random.default_rng(2)
    for width, most in ((1, 3), (64, 256), (700, 90_000), (100, 1 << 20)):
        a, b = draw.integers(-most, most + 1, (40, width)), draw.integers(-most, most + 1, (30, width))
        bound = int((np.linalg.norm(a.astype(float), axis=1).max() * np.linalg.norm(b.astype(float), axis=1).max()) * 1.000001) + 1
        primes = negatives.primes_for(bound)
        assert (negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes) == a @ b.T).all()
    with pytest.raises(ValueError, match="too large"):
        negatives.primes_for(1 << 59)


def brute_negatives(rows, is_anchor):
    fit = [(k, i, label, np.floor(256 * np.array(v, float)).astype(int)) for k, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a.tolist(), b.tolist())))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, i, label, v in fit:
        if i is None or not is_anchor(i):
            continue
        scored = [(j, dot(v, w), other == label) for m, j, other, w in fit if m != k]
        for p, s, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            fits = sorted((r for r in scored if not r[2] and 80 * s <= 100 * r[1] <= 100 * s), key=order)[:5]
            out += [(i, p, n, j, s, t) for n, (j, t, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "PIECE", 16)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 4)
    draw = np.random.default_rng(6)
    rows = [(i, int(draw.integers(0, 3)), [float(np.float32(x)) for x in draw.choice([-0.5, 0.25, 0.5, 0.75, 1.0], 4) * draw.choice([1, 1, 3])]) for i in range(120)]
    rows += [(10, 1, rows[10][2]), (10, 1, rows[10][2]), (None, 1, rows[10][2]), (20, None, [1.0] * 4), (30, 1, None), (500, 1, [1.0, None, 0.0, 0.0]), (510, 1, [float("nan")] * 4), (520, 2, [float("inf")] * 4)]
    rows += [(530, 2, []), (540, 2, [1.0, 1.0]), (550, 0, [1.0] * 7), (560, 9, [1.0] * 4), (570, 1, [-1.0] * 4), (580, 8, [9.0] * 4)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<float>, score int").repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_empty_tables(spark):
    rows = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, 1, [1.0])], rows.schema)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0


def brute_trie(messages):
    convs = defaultdict(list)
    for conv, turn, role, text in messages:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    end = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(m for m in members[p] if len(made[m]) == len(p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], end(p)) for p, m in members.items())


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 2)
    monkeypatch.setattr(prefixes, "STRETCH", 1)
    draw = random.Random(8)
    rows = []
    for c in [*range(90, 240), -3, -100, 7, 2**40, 1000]:
        rows += [(c, i if draw.random() > 0.05 else None, draw.choice(["user", "assistant", None]), draw.choice(["hi", "yo", "né", None, "", "x" * 50])) for i in range(draw.choice([1, 1, 2, 3, 7, 8, 9, 12]))]
    for c in (300, 301, 302, 350, 399):  # long ones that part late
        rows += [(c, i, "user", "same" if i < 37 or c < 302 else f"t{c}{i}") for i in range(45 + c % 3)]
    rows += [(500 + i, 1, "user", "copy") for i in range(60)] + [(None, 1, "user", "x"), (301, 3, "user", "same"), (301, 3, "user", "same")]
    rows += [(700, i, "user", "z" * 20_000) for i in range(20)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, block int, a string").repartition(5)
    got = prefixes.trie(*prefixes.rebuilt_turns(df))
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == brute_trie(rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_an_empty_table(spark):
    assert prefixes.trie(*prefixes.rebuilt_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_hard_negatives", "op13_prefix_trie"])
def test_new_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLES[name], "/root/testdata/sf0.001") is None
