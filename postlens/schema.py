"""Schemas, column lists and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table lacks a column that the operator needs."""


class EmptySourceError(ValueError):
    """The source exists but holds no rows."""


class MissingSourceError(ValueError):
    """The source path does not exist."""


COMMENT_RECORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("extracted_at", T.TimestampType()),
])

POST_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("video_url", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("likes", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("saves", T.LongType()),
    T.StructField("raw_likes", T.StringType()),
    T.StructField("raw_comments", T.StringType()),
    T.StructField("raw_saves", T.StringType()),
    T.StructField("comment_text", T.StringType()),
    T.StructField("comments_data", T.ArrayType(COMMENT_RECORD)),
    T.StructField("comment_count_extracted", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])

POST_COLUMNS = POST_SCHEMA.fieldNames()

# Labels, separators, limits and word lists that results depend on.
UNKNOWN = "Unknown"
COMMENT_SEPARATOR = "|||"
COMMENT_JOINER = " ||| "
MARGIN_LABEL = "All"
MAX_COMMENTS_PER_POST = 20
MAX_POSTS_PER_RUN = 200
COMMENT_RECORD_CHARS = 500
MODEL_TEXT_CHARS = 512
MODEL_BATCH = 32
CONFIDENT_ABOVE = 0.7
ENGAGEMENT_QUANTILE = 0.75
POST_ID_PATTERN = r"/video/(\d+)"
RELEVANCE_KEYWORDS = ("gta6", "gta 6", "grand theft auto", "rockstar", "lucia", "vice city")

# Domain stop words.
DOMAIN_STOP_WORDS = (
    "tiktok", "video", "gta", "gta6", "game", "gaming", "like", "get", "would", "could",
    "really", "one", "go", "see", "know", "think", "good", "bad", "way", "time", "make",
    "come", "want", "need",
)

# The common public English stop list, without the entries that hold an
# apostrophe or a single letter; a token is two or more word characters, so none matches.
ENGLISH_STOP_WORDS = tuple("""
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very can will just don should now ll re ve ain aren couldn didn doesn hadn
hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split())

STOP_WORDS = tuple(sorted({*ENGLISH_STOP_WORDS, *DOMAIN_STOP_WORDS}))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    return df


def validate_posts(df: DataFrame) -> DataFrame:
    """``caption`` must be present, and ``comment_text`` or ``comments``."""
    require_columns(df, "caption")
    if not {"comment_text", "comments"} & set(df.columns):
        raise SchemaError("missing both comment_text and comments")
    return df


def default_columns(df: DataFrame, with_comment_text: bool = False) -> list[str]:
    """Columns shown when the user names none; grows with the columns present."""
    wanted = ["caption", "sentiment_label", "sentiment_confidence", "comments"]
    if with_comment_text:
        wanted.append("comment_text")
    wanted += ["caption_emotion", "caption_emotion_confidence"]
    return [c for c in wanted if c in df.columns]
