"""Comment records: list of (text, time) as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.schema import COMMENT_RECORD


def comment_records(texts: Column, extracted_at: Column,
                    max_chars: int | None = None) -> Column:
    """Record list of a text list; with ``max_chars`` a record keeps so many characters."""
    def record(text: Column) -> Column:
        kept = F.substring(text, 1, max_chars) if max_chars else text
        return F.struct(kept.alias("text"), extracted_at.cast("timestamp").alias("extracted_at"))

    return F.transform(texts, record)


def records_to_json(records: Column) -> Column:
    return F.to_json(records)


def records_from_json(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(COMMENT_RECORD))
