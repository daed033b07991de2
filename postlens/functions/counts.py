"""Count strings and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import as_text, strip

# Plain decimal or exponent notation. Spark's own cast also takes type suffixes ("3d").
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
SUFFIXES = (("K", 1_000.0), ("M", 1_000_000.0), ("B", 1_000_000_000.0))


def to_number(c: Column) -> Column:
    """Double value of a numeric text, null for anything else."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_count(c: Column) -> Column:
    """``1.2K`` and the like to a whole number, truncated; 0 when it cannot be read.

    K, M and B are looked for in that order, anywhere in the text. The product
    is taken in double precision, as the truncation depends on it.
    """
    s = F.upper(as_text(c))

    def scaled(letter: str, factor: float) -> Column:
        return to_number(F.replace(s, F.lit(letter), F.lit(""))) * factor

    first, *others = SUFFIXES
    value = F.when(s.contains(first[0]), scaled(*first))
    for letter, factor in others:
        value = value.when(s.contains(letter), scaled(letter, factor))
    value = value.otherwise(to_number(F.regexp_replace(s, r"[^\d.]", "")))
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def metric_text(c: Column, compat: bool = False) -> Column:
    """The count inside a metric text such as ``12 likes``.

    ``compat`` keeps every digit, dot and K/M/B letter, so letters of words
    survive (``12 likes`` gives ``12k``). The strict form reads the first
    number, and a suffix only if it stands alone.
    """
    s = as_text(c)
    if compat:
        return F.regexp_replace(s, r"[^\d.KMBkmb]", "")
    count = r"\d[\d.,]*(?:\s*[KMBkmb](?![\p{L}\p{N}_]))?"
    return F.regexp_replace(F.regexp_extract(s, count, 0), r"[,\s]", "")


def coerce_count(c: Column) -> Column:
    """Numeric value of a column, 0 for null or unreadable values."""
    return F.coalesce(to_number(c), F.lit(0.0))


def round_half_even(c: Column, places: int) -> Column:
    """Scale, round half to even, scale back, all in double precision."""
    factor = float(10 ** places)
    return F.rint(c * factor) / factor
