"""Report aggregates.

All group keys here are labels, so the first step is always a map-side partial
aggregation; whatever follows works on one row per label (or per distinct count).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.counts import round_half_even
from postlens.operators.filters import confident
from postlens.schema import CONFIDENT_ABOVE, ENGAGEMENT_QUANTILE, require_columns
from postlens.session import materialized


def headline_metrics(posts: DataFrame) -> DataFrame:
    """Row count and the means of the score and count columns that are present."""
    means = {
        "avg_sentiment_confidence": "sentiment_confidence",
        "avg_emotion_confidence": "caption_emotion_confidence",
        "avg_comments": "comments",
    }
    return posts.agg(
        F.count("*").alias("total_posts"),
        *[F.avg(c).alias(name) for name, c in means.items() if c in posts.columns],
    )


def headline_text(metrics: DataFrame) -> DataFrame:
    """Headline metrics as text: thousands separators, percent with one decimal."""
    def shown(name: str) -> Column:
        if name.endswith("_confidence"):
            return F.concat(F.format_number(F.col(name) * 100, 1), F.lit("%"))
        return F.format_number(name, 0)

    return metrics.select(*[shown(c).alias(c) for c in metrics.columns])


def label_counts(posts: DataFrame, label: str) -> DataFrame:
    return posts.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def label_distribution(posts: DataFrame, label: str) -> DataFrame:
    """Frequency and share of each label, most frequent first."""
    counts = label_counts(posts, label)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share).orderBy(F.desc("n"), label)


def engagement_by(posts: DataFrame, label: str) -> DataFrame:
    """Mean comment count per label."""
    require_columns(posts, label, "comments")
    return (
        posts.where(F.col(label).isNotNull()).groupBy(label)
        .agg(F.avg("comments").alias("avg_comments"))
    )


def label_stats(posts: DataFrame, label: str, confidence: str, places: int = 3) -> DataFrame:
    """Mean and sample deviation of confidence and comments per label; one row has no deviation."""
    require_columns(posts, label, confidence, "comments")
    return (
        posts.where(F.col(label).isNotNull()).groupBy(label).agg(
            round_half_even(F.avg(confidence), places).alias("confidence_mean"),
            round_half_even(F.stddev_samp(confidence), places).alias("confidence_std"),
            round_half_even(F.avg("comments"), places).alias("comments_mean"),
            round_half_even(F.stddev_samp("comments"), places).alias("comments_std"),
        )
    )


def confident_emotions(posts: DataFrame, above: float = CONFIDENT_ABOVE,
                       places: int = 3) -> DataFrame:
    """Mean confidence and number of captions per emotion, over confident rows only."""
    return (
        confident(posts, above).where(F.col("caption_emotion").isNotNull())
        .groupBy("caption_emotion").agg(
            round_half_even(F.avg("caption_emotion_confidence"), places).alias("avg_confidence"),
            F.count("caption").alias("n_captions"),
        )
        .orderBy(F.desc("avg_confidence"), "caption_emotion")
    )


def _most_common(counts: DataFrame, label: str) -> DataFrame:
    """Label with the largest n and its share of all rows, from (label, n) rows.

    The smallest label wins among equals; rows with a null label count in the
    base only. No labelled row, no result row.
    """
    best = F.min(F.when(
        F.col(label).isNotNull(),
        F.struct((-F.col("n")).alias("minus_n"), F.col(label).alias("label")),
    ))
    return (
        counts.agg(best.alias("best"), F.sum("n").alias("total"))
        .where(F.col("best").isNotNull())
        .select(F.col("best.label").alias(label), (-F.col("best.minus_n") / F.col("total")).alias("share"))
    )


def top_label(posts: DataFrame, label: str) -> DataFrame:
    """Most common label and its share."""
    return _most_common(posts.groupBy(label).agg(F.count("*").alias("n")), label)


RANGES = 1024


def _within(hist: DataFrame, low: float, high: float) -> DataFrame:
    """(slot, n, least, most) over ``RANGES`` equal slots of the values from ``low`` to ``high``."""
    inside = hist.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
    scale = 1.0 if math.isfinite(high - low) else 0.5
    share = (F.col("v") * scale - F.lit(low * scale)) / F.lit(high * scale - low * scale)
    slot = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)) if high > low else F.lit(0)
    return inside.groupBy(slot.cast("int").alias("slot")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def histogram_quantile(histogram: DataFrame, value: str, n: str, q: float) -> DataFrame:
    """Exact quantile with linear interpolation, from (value, n) rows.

    The range that holds the two ranks is cut into slots, whose counts and least and
    largest values come from a plain aggregate, and narrowed to the slots that hold
    them, until each rank lies in a slot of one value. So no task puts values in order: a
    round fetches at most ``RANGES`` rows, however the values are spread, and
    narrows the range by that factor or to the values there are. Runs when it is
    called. Returns one row ``quantile``, null if there are no rows. NaN counts as the
    largest value.
    """
    spark = histogram.sparkSession
    hist = histogram.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("v"), F.col(n).cast("bigint").alias("n"))
    finite = hist.where(~F.isnan("v") & (F.abs("v") < F.lit(math.inf)))
    ends = hist.agg(F.sum("n"), F.sum(F.when(F.col("v") == F.lit(-math.inf), F.col("n")))).head()
    if not ends[0]:
        return spark.createDataFrame([(None,)], "quantile double")
    position = (ends[0] - 1) * q
    ranks = {math.floor(position), math.ceil(position)}
    found: dict[int, float] = {r: -math.inf for r in ranks if r < (ends[1] or 0)}
    span = finite.agg(F.min("v"), F.max("v"), F.sum("n")).head()
    last = (ends[1] or 0) + (span[2] or 0)
    if beyond := [r for r in ranks if r >= last]:
        infinite = hist.agg(F.sum(F.when(F.col("v") == F.lit(math.inf), F.col("n")))).head()[0] or 0
        found |= {r: math.inf if r < last + infinite else math.nan for r in beyond}
    ranges = [(span[0], span[1], ends[1] or 0, [r for r in ranks if r not in found])]
    while ranges:
        low, high, before, wanted = ranges.pop()
        if not wanted:
            continue
        for slot in _within(finite, low, high).orderBy("slot").collect():
            held = [r for r in wanted if before <= r < before + slot["n"]]
            if held and slot["least"] == slot["most"]:
                found |= dict.fromkeys(held, slot["least"])
            elif held:
                ranges.append((slot["least"], slot["most"], before, held))
            before += slot["n"]
    a, b = found[math.floor(position)], found[math.ceil(position)]
    part = position - math.floor(position)
    return spark.createDataFrame([(a if part == 0 else a + (b - a) * part,)], "quantile double")


def exact_quantile(df: DataFrame, column: str, q: float = ENGAGEMENT_QUANTILE) -> DataFrame:
    """Exact quantile of a column, found when this is called; its histogram is written once, so ``df`` is read once."""
    histogram = materialized(df.groupBy(column).agg(F.count("*").alias("n")), "histogram")
    return histogram_quantile(histogram, column, "n", q)


def approx_quantile(df: DataFrame, column: str, q: float = ENGAGEMENT_QUANTILE,
                    accuracy: int = 10_000) -> DataFrame:
    return df.agg(F.percentile_approx(column, q, accuracy).cast("double").alias("quantile"))


def high_engagement_label(posts: DataFrame, label: str = "sentiment_label",
                          q: float = ENGAGEMENT_QUANTILE) -> DataFrame:
    """Most common label among posts with more comments than the quantile.

    The posts are read once, when this is called: quantile, filter and count all
    work on the (label, comments) histogram, which is written to the shared folder.
    """
    require_columns(posts, label, "comments")
    hist = materialized(posts.groupBy(label, "comments").agg(F.count("*").alias("n")), "histogram")
    limit = histogram_quantile(hist.groupBy("comments").agg(F.sum("n").alias("n")), "comments", "n", q)
    above = hist.where(F.col("comments") > F.lit(limit.head()[0]))
    return _most_common(above.groupBy(label).agg(F.sum("n").alias("n")), label)


def result_summary(df: DataFrame, max_rows: int = 100) -> DataFrame:
    """Total rows, columns and displayed rows (``max_rows`` 0 shows all)."""
    total = F.count("*")
    shown = F.least(total, F.lit(max_rows).cast("bigint")) if max_rows else total
    return df.agg(
        total.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        shown.alias("displayed_rows"),
    )
