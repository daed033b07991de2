"""The whole analysis of a post table, and its report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postlens.operators import aggregates as A
from postlens.operators.comments import (
    caption_emotions, packed_comment_emotions, score_comments, summarize_comments, with_comment_summary,
)
from postlens.operators.crosstab import row_shares, with_margins
from postlens.operators.scoring import ColumnScorer, Scorer, score_sentiment
from postlens.schema import validate_posts


def full_analysis(posts: DataFrame, sentiment: Scorer, emotion: ColumnScorer,
                  analyze_captions: bool = True, analyze_comments: bool = True,
                  comments: DataFrame | None = None) -> DataFrame:
    """Sentiment of captions, emotion of captions, emotions of comments.

    Comments come packed in the posts' ``comment_text``, or as a table
    ``comments(video_id, pos, text)``. With packed comments this is one lazy chain of
    row-local steps: however large the table, nothing is shuffled. A table is summed
    up per post, map-side first, and joined to the posts; no list of a
    post's comments is built. Persist the result (``MEMORY_AND_DISK``) or write it when
    several reports are drawn from it.
    """
    checked = posts if comments is not None else validate_posts(posts)
    scored = score_sentiment(checked, sentiment)
    if analyze_captions:
        scored = caption_emotions(scored, emotion)
    if analyze_comments and comments is not None:
        summary = summarize_comments(score_comments(comments, emotion), emotion.labels)
        scored = with_comment_summary(scored, summary).withColumnRenamed("total_comments", "total_analyzed_comments")
    elif analyze_comments and "comment_text" in posts.columns:
        scored = packed_comment_emotions(scored, emotion)
    return scored


def reports(scored: DataFrame, sentiments: Sequence[str] | None = None,
            emotions: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All report tables of a scored table, by name. Lazy, but for the label
    look-ups and the engagement histogram.

    ``sentiments`` and ``emotions`` name the possible labels, if known.
    """
    out = {
        "headline": A.headline_metrics(scored),
        "sentiment_distribution": A.label_distribution(scored, "sentiment_label"),
        "engagement_by_sentiment": A.engagement_by(scored, "sentiment_label"),
        "sentiment_stats": A.label_stats(scored, "sentiment_label", "sentiment_confidence"),
        "top_sentiment": A.top_label(scored, "sentiment_label"),
        "high_engagement_sentiment": A.high_engagement_label(scored),
    }
    if "caption_emotion" in scored.columns:
        out |= {
            "emotion_distribution": A.label_distribution(scored, "caption_emotion"),
            "engagement_by_emotion": A.engagement_by(scored, "caption_emotion"),
            "emotion_stats": A.label_stats(scored, "caption_emotion", "caption_emotion_confidence"),
            "confident_emotions": A.confident_emotions(scored),
            "top_emotion": A.top_label(scored, "caption_emotion"),
            "emotion_by_sentiment": row_shares(scored, "caption_emotion", "sentiment_label", sentiments),
            "crosstab": with_margins(scored, "sentiment_label", "caption_emotion", emotions),
        }
    return out
