import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cloneloom.llm import components, simhash, vectors


def brute_components(linked):
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def test_simhash_equals_brute_force(documents, by_id):
    ids = np.array(sorted(by_id))
    prints = []
    for i in ids:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in by_id[i] or "").encode().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    linked = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3] for p in prints]
    label = brute_components(linked)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == {int(i): (p, int(ids[m])) for i, p, m in zip(ids, prints, label)}
    assert len(set(label)) < len(ids)


@pytest.mark.parametrize("chunk", [3, 1024])
def test_links_within_three_bits(spark, chunk):
    draw = np.random.default_rng(7)
    base = draw.integers(0, 1 << 64, 25, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(10):
            prints.add(int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(1, 5), replace=False)))
    prints = sorted(prints)
    linked = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3] for p in prints]
    label = brute_components(linked)
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    got = {r.node: r.component for r in components.components(simhash.near_links(classes, chunk)).collect()}
    assert {i: got.get(i, i) for i in range(len(prints))} == dict(enumerate(label.tolist()))


def test_simhash_null_and_repeated_ids(spark):
    rows = [(None, "a lone text with words"), (None, "another text of some words"), (None, "shared words are in here"), (5, "shared words are in here"),
            (3, "one"), (3, "one"), (3, "something else is said"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None)] * 4 + [(None, 5), (5, 5)] + [(3, 3)] * 3, key=str)
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.without_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(None, rows[0][1]), (None, rows[1][1]), (None, ""), (5, rows[3][1]), (3, "one"), (3, rows[6][1])], key=str)


def test_texts_that_share_an_id_and_large_ids(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six"), (7, "red green blue white black grey"), (2**62 + 5, "a text of its own with words"), (2**63 - 1, "the last id of all there are")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == sorted((i, i) for i, _ in rows)
    assert sorted((r.doc_id, r.text) for r in simhash.without_near_duplicates(docs).collect()) == sorted(rows)
    twice = docs.unionByName(docs.withColumn("lang", F.lit("de"))).unionByName(docs)
    assert sorted((r.doc_id, r.text, r.lang) for r in simhash.without_near_duplicates(twice).collect()) == sorted((r.doc_id, r.text, r.lang) for r in simhash.without_near_duplicates(twice.repartition(3)).collect())
    assert simhash.without_near_duplicates(twice).count() == 5


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90}


def cosine_brute(rows):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = [[i] for i in range(len(rows))]
    for i in ok:
        a = np.array(rows[i][1], float)
        linked[i] = [j for j in ok if len(rows[j][1]) == len(a) and np.dot(a, rows[j][1]) / np.linalg.norm(a) / np.linalg.norm(rows[j][1]) >= 0.9 or j == i]
    return [len(x) - 1 for x in linked], brute_components(linked)


@pytest.mark.parametrize("per_cell", [20, 3000])
def test_vectors_equal_brute_force(spark, monkeypatch, per_cell):
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    monkeypatch.setattr(vectors, "HOME_CHUNK", 16)
    monkeypatch.setattr(vectors, "OTHER_CHUNK", 24)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + draw.normal(size=8) * draw.choice([0.05, 0.3, 0.6])]) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(4)] + [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7)]
    rows += [(305, []), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [x * 1e-30 for x in rows[5][1]])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    n, label = cosine_brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {rows[i][0]: (n[i], rows[m][0]) for i, m in enumerate(label)}
    assert max(n) > 3


def test_many_pivots_take_little_memory():
    draw = np.random.default_rng(1)
    unit = lambda n: (x := draw.normal(size=(n, 768))) / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, x = unit(1024), unit(3000)
    tracemalloc.start()
    home, member = vectors._cells(x, pivots, vectors._apart(pivots), 0.1)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert (home == (x @ pivots.T).argmax(axis=1)).all() and member[np.arange(3000), home].all()
    short = pivots[:, :64] / np.linalg.norm(pivots[:, :64], axis=1, keepdims=True)
    exact = np.linalg.norm(short[:, None] - short[None], axis=2)
    assert (vectors._apart(short) >= exact - 1e-15).all() and np.allclose(vectors._apart(short), exact, atol=2e-6)


def test_vectors_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(None, [1.0]), (1, [1.0])], schema)).collect()
    assert sorted((r.vec_id is None, r.n_links) for r in got) == [(False, 0), (True, 0)]


@pytest.mark.parametrize("dense", [0, 1 << 16])
def test_vectors_are_written_once_and_repeated_ids_count_apart(spark, monkeypatch, dense):
    monkeypatch.setattr(vectors, "PER_CELL", 40)
    monkeypatch.setattr(vectors, "HOME_CHUNK", 30)
    monkeypatch.setattr(vectors, "DENSE", dense)
    sent, made = [], vectors.packed
    monkeypatch.setattr(vectors, "packed", lambda *a: sent.append(made(*a)) or sent[-1])
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=16)]) for i in range(400)] + [(7, [1.0] + [0.0] * 15), (7, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links) for r in vectors.near_vectors(df).collect())
    assert got == sorted((k, n) for (k, _), n in zip(rows, cosine_brute(rows)[0]))
    # On random vectors nearly all lie near every border; each is in one chunk all the same.
    lengths = [len(pa.ipc.open_stream(r.data).read_all()) for r in sent[0].collect()]
    assert sum(lengths) == len(rows) and max(lengths) <= 30
