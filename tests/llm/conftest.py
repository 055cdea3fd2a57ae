import random

import pytest

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", "ing", "ed", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd blanks, nulls, empties and a long one."""
    draw = random.Random(11)
    out = [prose(draw, draw.choice([0, 1, 3, 30, 80, 200])) for _ in range(60)]
    passage = prose(draw, 70)
    out += [prose(draw, 20) + " " + passage + " " + prose(draw, 20) for _ in range(6)]
    out += [out[9], out[9], out[40]]
    words = prose(draw, 300).split()
    for _ in range(6):
        words[draw.randrange(300)] = "changed"
        out.append(" ".join(words))
    out += [None, "", "   \n\t ", None, "é" * 70 + " " + "é" * 70, "a b\x0bc\x0cd\r\ne  f", " ".join(["same"] * 130), prose(draw, 6000)]
    out += ["ends in a copy " + passage, passage]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts as documents with columns that clash with results' names."""
    rows = [(i * 3 % 997, t, "en", f"s{i % 4}", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words int, ids string")


@pytest.fixture(scope="session")
def by_id(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
