"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_sample_name(col: str) -> Column:
    """The part of a name before the first '_', 'a', 'b' or '.' (F1)."""
    return F.regexp_extract(col, r"^([^_ab.]*)", 1)


def without_suffix(col: str, suffix: str) -> Column:
    """The name without a suffix, removed as a whole and once (F2)."""
    return F.when(F.endswith(F.col(col), F.lit(suffix)), F.substr(col, F.lit(1), F.length(col) - len(suffix))).otherwise(F.col(col))


def year_of(col: str, pivot: int = 18) -> Column:
    """A four-digit year from '1974', '74', '1/2/74' or '1.2.1974'; null if there is none.

    Two digits up to the pivot are in this century.
    """
    tail = F.regexp_extract(F.trim(col), r"(\d{4}|\d{2})$", 1)
    number = tail.try_cast("int")
    return F.when(F.length(tail) == 4, number).when(F.length(tail) == 2, F.when(number <= pivot, number + 2000).otherwise(number + 1900))


def years_since(col: str, mark: str = "20") -> Column:
    """Digits after a mark in a text, such as the year of a century."""
    return F.nullif(F.regexp_extract(col, rf"(?<={mark})(\w+)", 1), F.lit(""))


def age_from(birth: str, at: str) -> Column:
    """Years from a birth year of two or four digits to a year."""
    return F.col(at) - year_of(birth)


def months_between_dates(a: str, b: str) -> Column:
    """Calendar months from one date to another (F8)."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def body_mass_index(weight: str, height: str) -> Column:
    """kg / m^2; heights over 3 are taken as centimetres."""
    metres = F.when(F.col(height) > 3, F.col(height) / 100).otherwise(F.col(height))
    return F.try_divide(F.col(weight).cast("double"), metres * metres)


def round_up(col: str, step: float) -> Column:
    return F.ceil(F.col(col) / step) * step


def round_down(col: str, step: float) -> Column:
    return F.floor(F.col(col) / step) * step


def decimal_fold(col: str) -> Column:
    """Largest power of ten that is not above a positive value."""
    return F.when(F.col(col) > 0, F.pow(F.lit(10.0), F.floor(F.log10(col))))


def taxonomy_name(col: str, sep: str = "|") -> Column:
    """Last two ranks of a taxonomy path; unknown species keep their family."""
    ranks = F.split(col, "\\" + sep)
    last, before = F.try_element_at(ranks, F.lit(-1)), F.try_element_at(ranks, F.lit(-2))
    return F.when(F.contains(last, F.lit("unknown")), F.concat_ws(sep, F.try_element_at(ranks, F.lit(-3)), last)).otherwise(F.concat_ws(sep, before, last))


def map_to_string(col: str) -> Column:
    """'k:v,k:v' of a map, in the order of keys."""
    entries = F.array_sort(F.map_entries(col))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def age_group(col: str, edges: tuple[int, ...] = (30, 45, 60)) -> Column:
    """Label of the age's group."""
    labels = [f"<{edges[0]}", *[f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])], f">={edges[-1]}"]
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(F.col(col) < edge, label).otherwise(out)
    return F.when(F.col(col).isNotNull(), out)


def elapsed_hours(start: str, end: str, most: float = 160) -> Column:
    """Hours between two times; null if negative or above the limit (F16)."""
    hours = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 3.6e9
    return F.when((hours >= 0) & (hours <= most), hours)


def any_common(a: str, b: str) -> Column:
    """1 if two lists share an item."""
    return F.coalesce(F.arrays_overlap(a, b).cast("int"), F.lit(0))


def phred(col: str) -> Column:
    """Mean quality of a phred+33 string."""
    codes = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return F.try_divide(F.aggregate(codes, F.lit(0), lambda s, x: s + x).cast("double"), F.size(codes))
