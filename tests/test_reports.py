"""Report operators on small frames."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlens.operators import aggregates as A
from postlens.operators import crosstab as X
from postlens.operators import filters as P
from postlens.operators.ranking import first_per_key, head_rows, with_row_index
from postlens.schema import SchemaError, default_columns, validate_posts

COLUMNS = "video_id string, caption string, sentiment_label string, sentiment_confidence double, " \
          "caption_emotion string, caption_emotion_confidence double, comments bigint"
ROWS = [
    ("1", "New G.A x", "Positive", 0.5, "joy", 0.9, 10),
    ("2", "new gta y", "Positive", 0.7, "joy", 0.7, 20),
    ("3", None, "Negative", 0.9, "fear", 0.8, 30),
    ("4", "other", "Neutral", 0.1, None, None, 40),
    ("5", "Égal", None, 0.2, "joy", 0.95, 50),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(ROWS, COLUMNS).cache()


def ids(df):
    return sorted(r["video_id"] for r in df.collect())


def test_label_filters(posts):
    assert ids(P.with_labels(posts, [])) == []
    assert ids(P.with_labels(posts, ["Positive", "Neutral"])) == ["1", "2", "4"]
    assert ids(P.with_labels(posts, ["Positive", "Neutral"], [])) == ["1", "2", "4"]
    assert ids(P.with_labels(posts, ["Positive", "Negative"], ["fear"])) == ["3"]


def test_search(posts):
    assert ids(P.search_caption(posts, "G.A")) == ["1", "2"]
    assert ids(P.search_caption(posts, "G.A", literal=True)) == ["1"]
    assert ids(P.search_caption(posts, "ÉGAL")) == ["5"]
    assert len(ids(P.search_caption(posts, ""))) == 5


def test_confident_is_strict(posts):
    assert ids(P.confident(posts)) == ["1", "3", "5"]
    table = {r["caption_emotion"]: (r["avg_confidence"], r["n_captions"]) for r in A.confident_emotions(posts).collect()}
    assert table == {"joy": (0.925, 2), "fear": (0.8, 0)}


def test_topic_text(posts):
    assert [r[0] for r in posts.select(P.topic_text(posts, "comments")).collect()][2] == ""
    with_comments = posts.withColumn("comment_text", F.lit("c"))
    assert with_comments.select(P.topic_text(with_comments, "both").alias("t")).first()["t"] == "New G.A x c"
    with pytest.raises(ValueError):
        P.topic_text(posts, "nothing")


def test_distribution_and_stats(posts):
    rows = A.label_distribution(posts, "sentiment_label").collect()
    assert [(r[0], r["n"], r["share"]) for r in rows] == [
        ("Positive", 2, 0.5), ("Negative", 1, 0.25), ("Neutral", 1, 0.25)]
    stats = {r["sentiment_label"]: r for r in A.label_stats(posts, "sentiment_label", "sentiment_confidence").collect()}
    assert stats["Negative"]["confidence_std"] is None
    assert stats["Positive"]["confidence_mean"] == 0.6
    assert stats["Positive"]["comments_std"] == 7.071


def test_top_label(posts, spark):
    top = A.top_label(posts, "sentiment_label").first()
    assert (top[0], top["share"]) == ("Positive", 0.4)
    tied = spark.createDataFrame([("b",), ("a",)], "label string")
    assert A.top_label(tied, "label").first()[0] == "a"
    assert A.top_label(posts.limit(0), "sentiment_label").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(int(q * 100))
    values = [rng.choice([0, 0, 0, 1, 5]) for _ in range(200)] + [rng.randrange(10**6) for _ in range(101)]
    values += [-3.5, -1000.25]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert A.exact_quantile(frame, "v", q).first()[0] == pytest.approx(np.quantile(values, q))


def test_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert A.exact_quantile(empty, "v").first()[0] is None


def test_high_engagement(posts, spark):
    assert A.high_engagement_label(posts, q=0.5).first()[0] == "Neutral"
    flat = spark.createDataFrame([("a", 1), ("b", 1)], "sentiment_label string, comments bigint")
    assert A.high_engagement_label(flat).count() == 0


def test_missing_columns(posts):
    with pytest.raises(SchemaError):
        A.engagement_by(posts.drop("comments"), "sentiment_label")
    with pytest.raises(SchemaError):
        validate_posts(posts.drop("caption"))
    with pytest.raises(SchemaError):
        validate_posts(posts.drop("comments"))
    assert validate_posts(posts) is posts
    assert default_columns(posts.drop("caption_emotion")) == [
        "caption", "sentiment_label", "sentiment_confidence", "comments", "caption_emotion_confidence"]
    assert "avg_emotion_confidence" not in A.headline_metrics(posts.drop("caption_emotion_confidence")).columns


def _random_labels(spark, n=300):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice(["x", "y", None, "z"]) if i else "rare") for i in range(n)]
    return spark.createDataFrame(rows, "r string, c string"), pd.DataFrame(rows, columns=["r", "c"])


@pytest.mark.parametrize("labels", [None, ["x", "y", "z", "rare", "never"]])
def test_crosstab_against_pandas(spark, labels):
    frame, plain = _random_labels(spark)
    expected = pd.crosstab(plain.r, plain.c, margins=True)
    got = {(r["row_label"], r["col_label"]): r["n"] for r in X.with_margins(frame, "r", "c", labels).collect()}
    assert got == {(r, c): expected.loc[r, c] for r in expected.index for c in expected.columns}
    shares = pd.crosstab(plain.r, plain.c, normalize="index")
    for row in X.row_shares(frame, "r", "c", labels).collect():
        assert row["share"] == pytest.approx(shares.loc[row["row_label"], row["col_label"]])
    wide = X.wide(X.counts_long(frame, "r", "c"), "n", ["x", "y", "z", "rare"]).collect()
    assert len(wide) == 3 and wide[0].asDict().keys() == {"row_label", "x", "y", "z", "rare"}


def test_crosstab_refuses_ids(spark, monkeypatch):
    frame, _ = _random_labels(spark)
    monkeypatch.setattr(X, "MAX_COLUMN_LABELS", 2)
    with pytest.raises(X.TooManyLabels):
        X.column_labels(frame, "c")


def test_head_and_index(posts, spark):
    assert [r["video_id"] for r in head_rows(posts, F.desc("comments"), n=2).collect()] == ["5", "4"]
    assert head_rows(posts, "video_id", n=0).count() == 5
    with pytest.raises(ValueError):
        head_rows(posts)
    frame = spark.range(1000).withColumn("k", F.expr("(id * 7919) % 1009"))
    rows = with_row_index(frame, "k").orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(1000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_first_per_key_with_one_hot_key(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    kept = first_per_key(frame, "k", F.desc("id"), n=2)
    assert kept.where("k = -1").count() == 2
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_summary(posts):
    row = A.result_summary(posts, 2).first()
    assert (row["total_rows"], row["total_columns"], row["displayed_rows"]) == (5, 7, 2)
    assert A.result_summary(posts, 0).first()["displayed_rows"] == 5


def test_headline_text(spark):
    row = A.headline_text(spark.createDataFrame(
        [(1234567, 0.4567, 2345.6)], "total_posts bigint, avg_sentiment_confidence double, avg_comments double")).first()
    assert tuple(row) == ("1,234,567", "45.7%", "2,346")


def test_label_choices(posts):
    got = {(r["column_name"], r["label"]) for r in P.label_choices(posts, "sentiment_label", "caption_emotion").collect()}
    assert got == {("sentiment_label", x) for x in ("Positive", "Negative", "Neutral")} | {
        ("caption_emotion", "joy"), ("caption_emotion", "fear")}


@pytest.mark.parametrize("q", [0.0, 0.3, 0.75, 1.0])
def test_quantile_of_crowded_values(spark, q):
    """A million values in a thousandth: each round of ranges is an aggregate, and no window orders them."""
    values = spark.range(1_000_000).select((F.col("id") / 1e9).alias("v"))
    assert A.exact_quantile(values, "v", q).first()[0] == pytest.approx(q * 999_999 / 1e9, abs=1e-15)


def test_quantile_of_odd_values(spark):
    inf = float("inf")
    for values, q, want in (([1.0, 2.0], 0.5, 1.5), ([5.0], 0.75, 5.0), ([-inf, 0.0, inf], 0.5, 0.0), ([-1e308, 1e308], 1.0, 1e308), ([0.0, 0.0, 1e-300], 1.0, 1e-300),
                            ([1.0, inf], 1.0, inf), ([-inf, 3.0], 0.0, -inf)):
        assert A.exact_quantile(spark.createDataFrame([(v,) for v in values], "v double"), "v", q).first()[0] == want
    assert A.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v").first()[0] is None
    assert A.approx_quantile(spark.range(1, 101), "id", 0.75).first()[0] == pytest.approx(75, abs=1)


def test_elements_by_index_are_those_by_search(spark):
    """Nested, unclosed, self-closing and stray tags: the index finds what a search behind each opening tag finds."""
    import random

    from postlens.sources import pages as P

    rng = random.Random(9)
    bits = ["<span>", "<SPAN class=x>", "</span>", "</Span >", "<span/>", "text", " ", "<b>", "</b>", "<spanner>", "é", "\n", "<p><span a='>'>"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "<span>" * 3000]
    frame = spark.createDataFrame(list(enumerate(rows[:-1])), "i int, html string")
    opening = r"<(span)\b[^>]*>"
    by_search = P._elements(F.col("html"), r"(?:)" + opening, nested=True)
    both = frame.select("i", P._elements(F.col("html"), opening, nested=True).alias("a"), by_search.alias("b")).collect()
    assert all((r.a or []) == [x for x in r.b or [] if x is not None] for r in both) and sum(len(r.a or []) for r in both) > 500
    deep = spark.createDataFrame([(rows[-1] + "x",)], "html string").select(P._elements(F.col("html"), opening, nested=True).alias("a")).first()
    assert len(deep.a) == 3000 and deep.a[-1] == "x"


def test_markers_skip_no_page(spark):
    """A rule with a marker finds what its pattern finds on its own, whatever the case."""
    from dataclasses import replace

    from postlens.sources import pages as P

    rows = ['<b DATA-E2E="LIKE-count">5</b>', '<i title="All Likes">7</i>', '<i x="1" aria-label="9 likes" title="like">3</i>', "<p>like</p>",
            '<svg fill="#FF0050"></svg><strong>8</strong>', "", None]
    frame = spark.createDataFrame([(x,) for x in rows], "html string")
    rules = P.default_metric_rules()
    got = P.with_metrics(frame, rules).select("raw_likes").collect()
    assert got == P.with_metrics(frame, [replace(r, marker=None) for r in rules]).select("raw_likes").collect()
    assert [r.raw_likes for r in got][:2] == ["5", "7"]
