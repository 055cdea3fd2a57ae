"""The corpus pipeline against a plain version of its stages."""

import hashlib
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from cloneloom.llm import mixing, pieces, quality, secrets, simhash
from tests.llm.test_mixing import brute_schedule


@pytest.fixture(scope="module")
def few(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate([*texts, *(f"{t[:200]} token = {'0f' * 20} {t[200:]}" for t in texts[50:56] if t)])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain(rows, field):
    """doc_id and text of every row that should come out, with token ids."""

    def fails(text):
        n_words, chars, symbols, lines, dup, repeat, *_ = quality.measured(text)
        found = {
            "few_words": n_words < 10, "repeated_windows": 100 * repeat > 20 * n_words, "many_words": n_words > 1_000_000, "short_words": chars < 2 * n_words,
            "long_words": chars > 14 * n_words, "symbols": 10 * symbols > n_words, "repeated_lines": lines > 3 and 10 * dup > 3 * lines,
        }
        return any(found[r] for r in quality.POLICIES[quality.CURRENT])

    rows = [r for r in rows if not fails(r[1])]
    prints = [simhash.fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (p ^ prints[j]).bit_count() <= 3) for p in prints]
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    rows = [(r[0], secrets.redacted(r[1], secrets.scan(r[1], field)), r[3]) for r in rows]
    words = {r[0]: r[1].encode().split() for r in rows}
    texts = {r[0]: r[1] for r in rows}
    taken = brute_schedule(rows, mixing.PACKET)
    out = [(i, texts[i] if n == len(words[i]) else b" ".join(words[i][:n]).decode()) for (i, _), n in taken.items() if n]
    exact = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    return Counter((i, t, tuple(exact.encode(t))) for i, t in out)


def test_pipeline_equals_plain_version(spark, few):
    rows, docs = few
    for name, stage in corpus_pipeline.STAGES:
        if name == "secret_scan":
            field = secrets.fit(docs)
        docs = stage(spark, docs, "").cache()
        if name != "sentencepiece_encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter((r.doc_id, r.text, tuple(r.ids)) for r in docs.collect())
    assert got == plain(rows, field)
    assert any("[SECRET]" in t for _, t, _ in got)


def test_stages_on_an_empty_table(spark, few):
    docs = few[1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("not parity").count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark, texts):
    good = [t for t in texts if t and 25 < len(t.split()) < 400][:12]
    rows = [(None, good[0], None, "s"), (None, good[1], "en", None), (None, good[0], None, "s"), (5, good[2], "en", "s"), (5, good[3], "en", "s"), (5, good[2], "en", "s"), (6, None, "en", "s"), (7, "", None, None)]
    rows += [(10 + i, t, "en", "s") for i, t in enumerate(good[4:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, taken int, failed string, fp int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", 2) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert kept.count((True, 0)) == 2 and kept.count((False, 5)) == 2 and (False, 6) not in kept and (False, 7) not in kept
    for _, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, "")
    out = docs.collect()
    assert {r.doc_id for r in out} <= {None, 5, *range(10, 30)} and all(r.parity and r.n_tokens == len(r.ids) for r in out)
