"""Comments of posts: cleaning, packing, and emotions per post.

Two forms are covered. Packed: a post row carries its comment list, and all
work stays in the row. Long: one row per (video_id, pos), for comment tables of
any size; everything there is a partial aggregation, so a post with a very
large part of all comments is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.labels import count_labels, label_shares
from postlens.functions.text import comment_body, pack_comments, split_comments, sql_text
from postlens.operators.ranking import first_per_key
from postlens.operators.scoring import ColumnScorer, Scorer
from postlens.schema import UNKNOWN

NEST_ROWS = 10_000


def clean_comments(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """Valid comment texts per post as (video_id, pos, text).

    From (video_id, pos, text): the first real line of each block, equal texts
    of a post once (first position). A ``limit`` keeps so many per post, by position.
    """
    bodies = comments.select("video_id", "pos", comment_body(F.col("text")).alias("text"))
    unique = bodies.where(F.col("text").isNotNull()).groupBy("video_id", "text").agg(F.min("pos").alias("pos"))
    kept = first_per_key(unique, "video_id", "pos", n=limit) if limit else unique
    return kept.select("video_id", "pos", "text")


def pack_by_post(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """(video_id, comment_text, comment_count_extracted) from (video_id, pos, text).

    A packed field holds all comments of its post, or the first ``limit``. Where one
    post has more than a row can hold, keep the comments long: ``full_analysis``
    takes them as a table.
    """
    kept = first_per_key(comments, "video_id", "pos", n=limit) if limit else comments
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]
    )
    return kept.groupBy("video_id").agg(ordered.alias("_texts")).select(
        "video_id",
        pack_comments(F.col("_texts")).alias("comment_text"),
        F.size("_texts").alias("comment_count_extracted"),
    )


def explode_comments(posts: DataFrame, column: str = "comment_text") -> DataFrame:
    """Packed comments to (video_id, pos, text)."""
    return posts.select("video_id", F.posexplode(split_comments(F.col(column))).alias("pos", "text"))


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("video_id").agg(F.count("*").alias("total_comments"))


def score_comments(comments: DataFrame, scorer: Scorer) -> DataFrame:
    """(video_id, pos, text) with ``emotion`` and ``confidence``."""
    scored = scorer.add_score(comments, "text", "_score")
    return scored.withColumns({
        "emotion": F.col("_score.label"), "confidence": F.col("_score.confidence"),
    }).drop("_score")


def nest_comments(scored: DataFrame, posts: DataFrame, rows: int = NEST_ROWS) -> DataFrame:
    """Comment, emotion and confidence lists per post, in comment order.

    Posts without comments get empty lists; comments of posts that are not listed
    are left out, as in a left outer join from the posts. A list covers ``rows``
    positions: a longer post continues in further rows, numbered by ``chunk``, each
    with the post's ``total_comments``, and nothing is left out.
    """
    item = F.struct("pos", "text", "emotion", "confidence")
    chunk = F.floor(F.col("pos") / rows).cast("bigint")
    nested = scored.groupBy("video_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    totals = comment_counts(scored)
    joined = posts.select("video_id").distinct().join(totals, "video_id", "left").join(nested, "video_id", "left")
    none = F.array().cast(nested.schema["items"].dataType)
    filled = joined.select("video_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("items", none).alias("items"),
                           F.coalesce("total_comments", F.lit(0)).alias("total_comments"))
    return filled.select(
        "video_id", "chunk",
        F.col("items.text").alias("comments"),
        F.col("items.emotion").alias("emotions"),
        F.col("items.confidence").alias("confidences"),
        "total_comments",
    )


def _per_label(labels: Sequence[str]) -> list[tuple[str, Column]]:
    return [(x, F.col("emotion") == x) for x in labels]


def summarize_comments(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per post: dominant emotion (first seen wins a tie), mean confidence, number of
    comments, and ``<label>_percentage`` per label.

    ``labels`` are the labels the scorer can give. One shuffle, fixed-width
    partial sums.
    """
    known = sorted({*labels, UNKNOWN})
    grouped = scored.groupBy("video_id").agg(
        F.count("*").alias("total_comments"),
        F.avg("confidence").alias("avg_emotion_confidence"),
        *[F.count_if(hit).alias(f"_n{i}") for i, (_, hit) in enumerate(_per_label(known))],
        *[F.min(F.when(hit, F.col("pos"))).alias(f"_p{i}") for i, (_, hit) in enumerate(_per_label(known))],
    )
    ranked = [
        F.struct(F.col(f"_n{i}").alias("n"), (-F.col(f"_p{i}")).alias("first"), F.lit(x).alias("label"))
        for i, x in enumerate(known)
    ]
    percent = [
        (F.col(f"_n{i}") * 100.0 / F.col("total_comments")).alias(f"{x}_percentage")
        for i, x in enumerate(known)
    ]
    return grouped.select(
        "video_id", F.greatest(*ranked)["label"].alias("dominant_emotion"),
        "avg_emotion_confidence", "total_comments", *percent,
    )


def with_comment_summary(posts: DataFrame, summary: DataFrame) -> DataFrame:
    """Posts with their comment summary; Unknown, 0.0 and 0 where a post has none."""
    filled = posts.join(summary, "video_id", "left")
    numbers = {c: 0 for c in summary.columns if c.endswith("_percentage") or c == "total_comments"}
    return filled.na.fill({"dominant_emotion": UNKNOWN, "avg_emotion_confidence": 0.0, **numbers})


def summarize_list(df: DataFrame, column: str, scorer: ColumnScorer) -> DataFrame:
    """Row-local summary of a packed text column, put in a struct ``_summary``.

    Fields: comments, emotions, confidences, total, dominant, confidence, percent.
    """
    staged = df.withColumn("_texts", split_comments(F.col(column)))
    staged = staged.withColumn("_scores", scorer.score_list("_texts"))
    staged = staged.withColumns({"_counts": count_labels("_scores.label"), "_total": F.expr("bigint(size(_texts))")})
    summary = F.struct(
        F.expr("_texts AS comments"), F.expr("_scores.label AS emotions"),
        F.expr("_scores.confidence AS confidences"), F.expr("_total AS total"),
        F.expr(f"coalesce(array_max(_counts).label, '{UNKNOWN}') AS dominant"),
        F.expr("IF(_total > 0, reduce(_scores.confidence, 0D, (a, b) -> a + b) / _total, 0D) AS confidence"),
        label_shares("_counts", "_total").alias("percent"),
    )
    return staged.withColumn("_summary", summary).drop("_texts", "_scores", "_counts", "_total")


def caption_emotions(posts: DataFrame, scorer: ColumnScorer, column: str = "caption") -> DataFrame:
    """``<column>_emotion`` and its confidence; the text is split like a packed comment field."""
    return summarize_list(posts, column, scorer).withColumns({
        f"{column}_emotion": F.col("_summary.dominant"),
        f"{column}_emotion_confidence": F.col("_summary.confidence"),
    }).drop("_summary")


def packed_comment_emotions(posts: DataFrame, scorer: ColumnScorer,
                            column: str = "comment_text") -> DataFrame:
    """Comment emotions of posts that carry their comments, without a shuffle.

    Adds individual_comment_emotions, dominant_emotion, avg_emotion_confidence,
    total_analyzed_comments and, for each label, ``<label>_percentage``.
    """
    detail = "named_struct('comments', _summary.comments, 'emotions', _summary.emotions, " \
             "'confidences', _summary.confidences, 'total_comments', _summary.total)"
    percents = {
        f"{x}_percentage": F.expr(f"coalesce(_summary.percent[{sql_text(x)}], 0D)")
        for x in sorted({*scorer.labels, UNKNOWN})
    }
    return summarize_list(posts, column, scorer).withColumns({
        "individual_comment_emotions": F.expr(detail),
        "dominant_emotion": F.col("_summary.dominant"),
        "avg_emotion_confidence": F.col("_summary.confidence"),
        "total_analyzed_comments": F.col("_summary.total"),
        **percents,
    }).drop("_summary")


def emotion_labels(scored: DataFrame) -> DataFrame:
    """Every emotion seen over all comments."""
    return scored.select("emotion").distinct()
