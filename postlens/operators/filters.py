"""Row filters and projections of the report tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.counts import round_half_even
from postlens.functions.text import as_text, contains_any
from postlens.schema import CONFIDENT_ABOVE, RELEVANCE_KEYWORDS


def with_labels(posts: DataFrame, sentiments: Sequence[str],
                emotions: Sequence[str] = ()) -> DataFrame:
    """Posts with a chosen sentiment and, if any emotion is chosen, a chosen emotion.

    No chosen sentiment means no rows; no chosen emotion means no emotion filter.
    """
    kept = posts.where(F.col("sentiment_label").isin(*sentiments) if sentiments else F.lit(False))
    if emotions and "caption_emotion" in posts.columns:
        kept = kept.where(F.col("caption_emotion").isin(*emotions))
    return kept


def label_choices(posts: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of label columns as (column_name, label), in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label")) for c in columns])
    return posts.select(F.inline(pairs)).where(F.col("label").isNotNull()).distinct()


def search_caption(posts: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Posts whose caption matches a case-insensitive pattern; a blank term keeps all."""
    if not term:
        return posts
    pattern = re.escape(term) if literal else term
    return posts.where(F.coalesce(F.col("caption").rlike(f"(?iu){pattern}"), F.lit(False)))


def relevant(posts: DataFrame, keywords: Sequence[str] = RELEVANCE_KEYWORDS,
             column: str = "caption") -> DataFrame:
    return posts.where(contains_any(F.col(column), keywords))


def confident(posts: DataFrame, above: float = CONFIDENT_ABOVE) -> DataFrame:
    return posts.where(F.col("caption_emotion_confidence") > above)


def topic_text(posts: DataFrame, source: str = "captions") -> Column:
    """Document text for topic work: ``captions``, ``comments`` or ``both``.

    Without a comment column, ``comments`` falls back to the captions.
    """
    if source not in ("captions", "comments", "both"):
        raise ValueError(f"unknown text source: {source}")
    caption = as_text(F.col("caption"))
    comments = as_text(F.col("comment_text")) if "comment_text" in posts.columns else None
    if source == "both":
        return F.concat(caption, F.lit(" "), F.lit("") if comments is None else comments)
    return comments if source == "comments" and comments is not None else caption


def project_rounded(df: DataFrame, columns: Sequence[str], places: int = 3) -> DataFrame:
    """Chosen columns, with floating-point values rounded half to even."""
    types = {f.name: f.dataType for f in df.schema}
    fractional = (T.DoubleType, T.FloatType)
    return df.select(*[
        round_half_even(F.col(c), places).alias(c) if isinstance(types[c], fractional) else F.col(c)
        for c in columns
    ])
