"""Quality rules as a ledger of failure bits.

Each text is measured once and each rule is evaluated once; a row keeps the measurements and one bit per
failed rule.  A policy is a bit mask with a version: it rejects a document that fails any of its rules.
Policies and ablations are then bitwise arithmetic on the ledger and never look at a text again.

Edge cases: null and empty texts have no words and fail few_words; every text is measured whole; repeated
rows are measured each; an empty table gives an empty ledger; other columns pass through measure() untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_alpha_words long, n_stop_words long, n_bullet_lines long, n_ellipsis_lines long"
)
#: Words that English prose can't do without (fixed values).
STOP_WORDS = (b"the", b"be", b"to", b"of", b"and", b"that", b"have", b"with")
BULLETS, ELLIPSES = ("-", "*", "\u2022"), ("...", "\u2026")

#: Rules in the order of their bits: name and the SQL condition of failing.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "few_letters": "100 * n_alpha_words < 70 * n_words",
    "bullets": "10 * n_bullet_lines > 9 * n_lines",
    "ellipses": "10 * n_ellipsis_lines > 3 * n_lines",
    "no_stop_words": "n_stop_words < 2",
}
BASE = ("few_words", "repeated_windows")
#: Policies by version.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "many_words", "symbols"),
    "v2": (*BASE, "many_words", "short_words", "long_words", "symbols", "repeated_lines"),
    "v3": tuple(r for r in RULES if r != "no_stop_words"),
    # For English alone: texts in other languages have other stop words.
    "v3_english": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, until = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


def measured(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at just the six blanks
    lines = [x.strip(BLANKS) for x in text.split("\n")]
    lines, whole = [x for x in lines if x], [x for x in text.split("\n") if x.strip(BLANKS)]
    found = Counter(words)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(whole) - len(set(whole)),
        repeated_words(words),
        sum(n for w, n in found.items() if w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "surrogatepass")))),
        sum(map(found.__getitem__, STOP_WORDS)),
        sum(x.startswith(BULLETS) for x in lines),
        sum(x.endswith(ELLIPSES) for x in lines),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES."""

    @F.pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        rows = [measured(t) for t in texts]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")]).astype("int64")

    return docs.withColumn("_m", measures(F.col(text))).select(*[c for c in docs.columns if c not in _names()], "_m.*")


def _names() -> list[str]:
    return [x.split()[0] for x in MEASURES.split(", ")]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and failed, the bits of the rules that a document fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", failed.cast("long"))


def kept(policy: str = CURRENT) -> F.Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policies: Sequence[str] = (CURRENT,)) -> DataFrame:
    """For each rule of each policy: documents that fail it, that fail it alone, and that would stay without it; one pass over the ledger."""
    sums, each = [F.count("*").alias("n_docs")], []
    for p, policy in enumerate(policies):
        whole = mask(policy)
        under = F.col("failed").bitwiseAND(F.lit(whole))
        sums.append(F.sum((under == 0).cast("long")).alias(f"kept{p}"))
        for i, rule in enumerate(RULES):
            if whole >> i & 1:
                sums += [F.sum(F.expr(f"cast(failed >> {i} & 1 as bigint)")).alias(f"failed{p}_{i}"), F.sum((under == (1 << i)).cast("long")).alias(f"alone{p}_{i}")]
                each.append(F.struct(F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), F.col(f"failed{p}_{i}").alias("n_failed"), F.col(f"alone{p}_{i}").alias("n_failed_alone"), F.col(f"kept{p}").alias("n_kept")))
    return rows.agg(*sums).select("n_docs", F.inline(F.array(*each))).select(
        "policy", "rule", "n_failed", "n_failed_alone", "n_docs", (F.col("n_kept") + F.col("n_failed_alone")).alias("n_kept_without")
    )
