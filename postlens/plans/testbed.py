"""The given tables as posts, comments and pages.

documents are posts, conversations their comments (post = conversation, position
= turn), events count as comments of a post, labels carry the sentiment, pages
are raw pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.comments import pack_by_post
from postlens.operators.scoring import LexiconScorer
from postlens.session import spread
from postlens.sources.pages import METRICS, CommentRule, ExtractionRule, pages_to_posts

EMOTIONS = ("joy", "anger", "fear", "sadness", "surprise", "disgust")
EMOTION_LEXICON = (
    ("joy", "the", 1.0), ("joy", "and", 1.0), ("anger", "of", 1.0), ("anger", "in", 1.0),
    ("fear", "la", 1.0), ("fear", "de", 1.0), ("sadness", "que", 1.0), ("sadness", "el", 1.0),
    ("surprise", "der", 1.0), ("surprise", "und", 1.0), ("disgust", "en", 1.0),
)
EMOTION_DEFAULT = "neutral"
SENTIMENTS = ("Negative", "Neutral", "Positive")
SENTIMENT_LEXICON = (
    ("Negative", "de", 1.0), ("Negative", "of", 1.0), ("Negative", "die", 2.0),
    ("Neutral", "is", 0.5), ("Neutral", "les", 1.0),
    ("Positive", "the", 1.0), ("Positive", "la", 1.5), ("Positive", "und", 1.0),
)
SENTIMENT_DEFAULT = "Neutral"
EMOTION_OF_LANG = {"en": "joy", "fr": "fear", "de": "anger", "es": "sadness"}

PAGE_ID = r"/(\d+)"
CAPTION_RULES = (
    ExtractionRule("caption", 0, r"(?is)<h1\b[^>]*>(.*?)</h1>"),
    ExtractionRule("caption", 1, r"(?is)<title\b[^>]*>(.*?)</title>"),
)
METRIC_RULES = (
    ExtractionRule("likes", 0, r"track\((\d+)\)"),
    ExtractionRule("comments", 0, r"page=(\d+)", source="url"),
    ExtractionRule("saves", 0, r"<!-- ad (\d+) -->"),
)
PAGE_COMMENTS = CommentRule(r"<(p)\b[^>]*>")
PAGE_KEYWORDS = ("the", "der", "que", "les")


def emotion_scorer() -> LexiconScorer:
    return LexiconScorer(EMOTION_LEXICON, EMOTIONS, EMOTION_DEFAULT)


def sentiment_scorer() -> LexiconScorer:
    return LexiconScorer(SENTIMENT_LEXICON, SENTIMENTS, SENTIMENT_DEFAULT)


# Named here, so that no query starts with a job that reads file footers.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for text work, spread over the cores if its file has few splits."""
    return spread(table(spark, folder, name))


def sentiment_of(toxic: Column, quality: Column) -> Column:
    return (
        F.when(toxic == 1, "Negative").when(quality == 1, "Positive")
        .when(toxic.isNotNull() | quality.isNotNull(), "Neutral").otherwise("Unknown")
    )


def emotion_of(lang: Column) -> Column:
    first, *others = EMOTION_OF_LANG.items()
    chosen = F.when(lang == first[0], first[1])
    for code, emotion in others:
        chosen = chosen.when(lang == code, emotion)
    return chosen


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), "text"
    )


def posts(spark: SparkSession, folder: str, packed: bool = False, timed: bool = False) -> DataFrame:
    """Scored posts; ``packed`` adds comment_text, ``timed`` the first event time.

    Every side is reduced to one row per post before it is joined, so a post
    with very many events or turns does not meet the join.
    """
    docs = (texts if packed else table)(spark, folder, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.col("text").alias("caption"),
        emotion_of(F.col("lang")).alias("caption_emotion"),
        (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("sentiment_confidence"),
        ((F.col("doc_id") % 10).cast("double") / 10).alias("caption_emotion_confidence"),
    )
    labels = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("video_id")).agg(
        F.max("toxic").alias("toxic"), F.max("quality").alias("quality")
    )
    first = [F.min("ts").alias("timestamp")] if timed else []
    counts = table(spark, folder, "events").groupBy(F.col("user_id").alias("video_id")).agg(
        F.count("*").alias("comments"), *first
    )
    joined = docs.join(labels, "video_id", "left").join(counts, "video_id", "left")
    joined = joined.withColumns({
        "sentiment_label": sentiment_of(F.col("toxic"), F.col("quality")),
        "comments": F.coalesce("comments", F.lit(0)),
    }).drop("toxic", "quality")
    if packed:
        joined = joined.join(pack_by_post(comments(spark, folder)), "video_id", "left")
    return joined


def page_posts(pages: DataFrame) -> DataFrame:
    return pages_to_posts(pages, CAPTION_RULES, METRIC_RULES, PAGE_COMMENTS, PAGE_ID, keep=("page_id",))


PAGE_METRICS = METRICS
