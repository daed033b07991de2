"""From class scores to labels, and row-local summaries of label lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.schema import UNKNOWN


def labelled(label: Column, confidence: Column) -> Column:
    return F.struct(label.alias("label"), confidence.cast("double").alias("confidence"))


def unknown() -> Column:
    return labelled(F.lit(UNKNOWN), F.lit(0.0))


def label_at(labels: Sequence[str], index: Column) -> Column:
    """Label of a 0-based class index; null or out of range gives Unknown."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.get(names, index), F.lit(UNKNOWN))


def best_class(scores: Column, labels: Sequence[str] | str, softmax: bool = True) -> Column:
    """Best label of a score array and its probability; the first wins a tie.

    ``labels`` are the classes' names, or a prefix to the class number.

    ``scores`` should be a plain column. With ``softmax`` the scores are
    logits; the largest one's probability is 1 / sum(exp(x - max)).
    """
    top = F.array_max(scores)
    index = (F.array_position(scores, top) - 1).cast("int")
    if softmax:
        gaps = F.zip_with(
            scores, F.array_repeat(top, F.size(scores)),
            lambda x, m: F.exp(x.cast("double") - m.cast("double")),
        )
        confidence = 1.0 / F.reduce(gaps, F.lit(0.0), lambda total, g: total + g)
    else:
        confidence = top
    name = F.concat(F.lit(labels), index.cast("string")) if isinstance(labels, str) else label_at(labels, index)
    return F.when(top.isNull(), unknown()).otherwise(labelled(name, confidence))


def count_labels(labels: str) -> Column:
    """``array<struct<n, first, label>>`` of a named label list column.

    ``first`` is minus the rank of first sight, so that ``array_max`` gives the
    most frequent label and, among equals, the one seen first.
    """
    return F.expr(
        f"transform(array_distinct({labels}), (x, i) -> named_struct("
        f"'n', bigint(size(filter({labels}, y -> y = x))), 'first', -i, 'label', x))"
    )


def label_shares(counts: str, total: str) -> Column:
    """Percent per label as a map, from a :func:`count_labels` column and the named total."""
    return F.expr(
        f"map_from_entries(transform({counts}, c -> named_struct("
        f"'label', c.label, 'share', c.n * 100D / {total})))"
    )
