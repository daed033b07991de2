"""Text columns: cleaning, tokens, n-grams, packed comment lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.schema import COMMENT_JOINER, COMMENT_SEPARATOR

# Inside a character class: every Unicode space, and the letters and digits of any script.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
# Two or more word characters of any script.
TOKEN = r"(?U)\w{2,}"

_SPACES = [range(0x09, 0x0E), range(0x1C, 0x21), [0x85, 0xA0, 0x1680], range(0x2000, 0x200B),
           [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
SPACE_CHARS = "".join(chr(code) for codes in _SPACES for code in codes)

# Patterns that scan whole texts use at most one range and one character per class, or one
# named class: larger unions are several times slower when many threads share a JVM.


def sql_text(value: str) -> str:
    """A string literal of Spark SQL. Expressions over constant tables are written as SQL
    text: one call builds them, where the function API needs one call per constant."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(sql_text(v) for v in values)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def sql_is_blank(expression: str) -> str:
    """:func:`is_blank` as SQL text, for use inside lambdas."""
    return f"({expression} IS NULL OR trim(BOTH {sql_text(SPACE_CHARS)} FROM {expression}) = '')"


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """Lower-cased ASCII words with single spaces; links, handles and tags are dropped."""
    spaced = F.regexp_replace(F.lower(as_text(c)), r"[\x1c-\x1f]", " ")
    spaced = F.regexp_replace(spaced, r"(?U)\s+", " ")
    no_links = F.regexp_replace(spaced, "(?:http|www)[^ ]+", "")
    no_marks = F.regexp_replace(no_links, f"[@#][{WORD}]+", "")
    letters = F.regexp_replace(no_marks, "[^a-z ]+", "")
    return F.trim(F.regexp_replace(letters, " {2,}", " "))


def tokens(c: Column) -> Column:
    """Runs of two or more word characters (of any script), in text order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    """The same for cleaned text, which has lower-case ASCII letters and spaces only."""
    return F.regexp_extract_all(c, F.lit("[a-z]{2,}"), F.lit(0))


def without(words: str, stop_words: Sequence[str]) -> Column:
    """The word list column ``words`` without the stop words."""
    if not stop_words:
        return F.col(words)
    return F.expr(f"filter(`{words}`, w -> w NOT IN ({sql_list(stop_words)}))")


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``; ``words`` should be a plain column."""
    grams, parts = words, []
    for n in range(1, high + 1):
        if n > 1:
            kept = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), kept),
                F.slice(words, F.lit(n), kept),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        if n >= low:
            parts.append(grams)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def split_comments(c: Column, separator: str = COMMENT_SEPARATOR) -> Column:
    """Packed text to a list of trimmed, non-blank comments; null gives an empty list."""
    pieces = F.transform(F.split(as_text(c), rf"\Q{separator}\E"), strip)
    return F.array_remove(pieces, "")


def pack_comments(comments: Column, joiner: str = COMMENT_JOINER) -> Column:
    return F.array_join(comments, joiner)


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    """True where the lower-cased text holds one of the keywords; blank gives false."""
    lowered = F.lower(as_text(c))
    return reduce(lambda a, b: a | b, (lowered.contains(k) for k in keywords), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    For costly expressions inside a branch, where Spark does not share them.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_non_blank(candidates: Sequence[Column]) -> Column:
    """First candidate that is not blank, trimmed; empty text if there is none.

    Later candidates are evaluated only where the earlier ones are blank.
    """
    found = [once(strip(c), lambda x: F.when(x != "", x)) for c in candidates]
    return F.coalesce(*found, F.lit(""))


def comment_body(c: Column) -> Column:
    """First line of a comment block that is a real comment, or null.

    A line counts when it is longer than ten characters and is not just a
    number, a handle or an age mark.
    """
    lines = F.transform(F.split(as_text(c), "\n"), strip)
    return F.get(F.filter(lines, is_comment_line), F.lit(0))


def is_comment_line(line: Column) -> Column:
    noise = rf"^(?:\d+[KMkm]?|@[{WORD}]+|\d+[hdwmy])$"
    return (F.length(line) > 10) & ~line.rlike(noise)


def longest_fragment(fragments: Column, whole: Column) -> Column:
    """Longest fragment, the first among equals; the whole text if all are empty."""
    return F.reduce(
        fragments, F.lit(""),
        lambda kept, x: F.when(F.length(x) > F.length(kept), x).otherwise(kept),
        lambda kept: F.when(F.length(kept) > 0, kept).otherwise(whole),
    )
