"""Scorers and comment emotions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postlens.operators import comments as C
from postlens.operators.scoring import (
    BatchScorer, ClassifierScorer, LexiconScorer, LexiconTableScorer, score_sentiment, score_text,
)
from postlens.plans import testbed as T
from postlens.plans.analysis import full_analysis, reports

LEXICON = [("joy", "good", 1.0), ("joy", "fine", 2.0), ("fear", "dark", 2.0), ("fear", "good", 0.5)]
LABELS = ["fear", "joy"]


def lexicon():
    return LexiconScorer(LEXICON, LABELS, "neutral")


def fake_model():
    """A stand-in network: the score of a label is the number of its letters in the text."""
    def predict(model, texts):
        assert model == "weights" and 0 < len(texts) <= 2
        return [{"a": t.count("a") / 10, "b": t.count("b") / 10} for t in texts]

    return BatchScorer(lambda: "weights", predict, ["a", "b"], batch_size=2, max_chars=4)


def test_lexicon(column):
    texts = ["Good, fine", "dark", "nothing here", "  ", None, "fine dark"]
    out = column(texts, lexicon().score("x"))
    assert [r["label"] for r in out] == ["joy", "fear", "neutral", "Unknown", "Unknown", "fear"]
    assert out[0]["confidence"] == pytest.approx(3 / 3.5)
    assert [r["confidence"] for r in out[2:5]] == [0.0, 0.0, 0.0]
    assert out[5]["confidence"] == 0.5  # a tie goes to the first label


def test_lexicon_table_gives_the_same(spark):
    rng = random.Random(5)
    words = ["good", "fine", "dark", "x1", "y2"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(200)] + [(999, None)]
    texts = spark.createDataFrame(rows, "id int, caption string")
    table = spark.createDataFrame(
        [(lab, LABELS.index(lab), t, w) for lab, t, w in LEXICON],
        "label string, label_pos int, term string, weight double")
    small = score_sentiment(texts, lexicon()).orderBy("id").collect()
    large = score_sentiment(texts, LexiconTableScorer(table, LABELS, "neutral", "id")).orderBy("id").collect()
    assert [(r["id"], r["sentiment_label"], round(r["sentiment_confidence"], 9)) for r in small] == [
        (r["id"], r["sentiment_label"], round(r["sentiment_confidence"], 9)) for r in large]


def test_lexicon_is_bounded():
    with pytest.raises(ValueError):
        LexiconScorer([("joy", f"w{i}", 1.0) for i in range(201)], ["joy"], "neutral")


def test_batch_scorer(spark):
    texts = spark.createDataFrame([(1, "aab"), (2, " "), (3, None), (4, "bbbbaaaaaaa"), (5, "abc")], "i int, x string")
    out = {r["i"]: (r["l"], r["c"]) for r in score_text(texts, "x", fake_model(), "l", "c").collect()}
    assert out == {1: ("a", 0.2), 2: ("Unknown", 0.0), 3: ("Unknown", 0.0), 4: ("b", 0.4), 5: ("a", 0.1)}


def test_batch_scorer_over_lists(spark):
    rows = [(1, "aa ||| b ||| aab"), (2, None), (3, "b")]
    posts = spark.createDataFrame(rows, "video_id int, comment_text string")
    out = {r["video_id"]: r for r in C.packed_comment_emotions(posts, fake_model()).collect()}
    assert out[1]["dominant_emotion"] == "a" and out[1]["total_analyzed_comments"] == 3
    assert out[1]["individual_comment_emotions"]["emotions"] == ["a", "b", "a"]
    assert out[1]["a_percentage"] == pytest.approx(200 / 3)
    assert out[2]["dominant_emotion"] == "Unknown" and out[2]["a_percentage"] == 0.0


def test_classifier(spark):
    rows = [(i, "good fine" if i % 2 else "dark night", "Positive" if i % 2 else "Negative") for i in range(60)]
    train = spark.createDataFrame(rows + [(99, "other", "Unlisted")], "i int, caption string, y string")
    scorer = ClassifierScorer.fit(train, "caption", "y", ["Negative", "Neutral", "Positive"])
    test = spark.createDataFrame([(1, "fine"), (2, "night"), (3, " "), (4, None)], "i int, caption string")
    out = {r["i"]: r for r in score_sentiment(test, scorer).collect()}
    assert [out[i]["sentiment_label"] for i in (1, 2, 3, 4)] == ["Positive", "Negative", "Unknown", "Unknown"]
    assert 0.5 < out[1]["sentiment_confidence"] <= 1.0 and out[4]["sentiment_confidence"] == 0.0


COMMENTS = [
    ("p1", 0, "good"), ("p1", 1, "dark"), ("p1", 2, "dark dark"), ("p1", 3, "good good"),
    ("p2", 0, "nothing"), ("p3", 0, " "),
]


@pytest.fixture(scope="module")
def scored(spark):
    comments = spark.createDataFrame(COMMENTS, "video_id string, pos bigint, text string")
    return C.score_comments(comments, lexicon()).cache()


def test_summary_of_comments(spark, scored):
    posts = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "video_id string")
    summary = C.summarize_comments(scored, lexicon().labels)
    rows = {r["video_id"]: r for r in C.with_comment_summary(posts, summary).collect()}
    assert rows["p1"]["dominant_emotion"] == "joy"  # tie 2:2, first seen wins
    assert rows["p1"]["total_comments"] == 4 and rows["p1"]["fear_percentage"] == 50.0
    assert rows["p2"]["dominant_emotion"] == "neutral"
    assert rows["p3"]["dominant_emotion"] == "Unknown" and rows["p3"]["Unknown_percentage"] == 100.0
    assert (rows["p4"]["dominant_emotion"], rows["p4"]["avg_emotion_confidence"], rows["p4"]["total_comments"]) == (
        "Unknown", 0.0, 0)
    for r in rows.values():
        total = sum(v for k, v in r.asDict().items() if k.endswith("_percentage"))
        assert total == pytest.approx(100.0 if r["total_comments"] else 0.0)


def test_nested_comments_split_long_posts(spark, scored):
    posts = spark.createDataFrame([("p1",), ("p4",)], "video_id string")
    one = {(r["video_id"], r["chunk"]): r for r in C.nest_comments(scored.where("video_id = 'p1'"), posts).collect()}
    assert one[("p1", 0)]["comments"] == ["good", "dark", "dark dark", "good good"]
    assert one[("p1", 0)]["emotions"] == ["joy", "fear", "fear", "joy"]
    assert one[("p4", 0)]["comments"] == [] and one[("p4", 0)]["total_comments"] == 0
    parts = C.nest_comments(scored.where("video_id = 'p1'"), posts, rows=3).orderBy("video_id", "chunk").collect()
    assert [(r["video_id"], len(r["comments"]), r["total_comments"]) for r in parts] == [("p1", 3, 4), ("p1", 1, 4), ("p4", 0, 0)]
    orphans = C.nest_comments(scored, posts)
    assert {r["video_id"] for r in orphans.collect()} == {"p1", "p4"}


def test_late_comments_count(spark):
    """The last of 60 comments of a post decide its emotion, packed and long."""
    texts = ["good"] * 20 + ["dark"] * 40
    comments = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "video_id string, pos int, text string")
    posts = spark.createDataFrame([("p", "good"), ("q", "good")], "video_id string, caption string")
    long = full_analysis(posts, lexicon(), lexicon(), comments=comments)
    packed = full_analysis(posts.join(C.pack_by_post(comments), "video_id", "left"), lexicon(), lexicon())
    for frame in (long, packed):
        p, q = frame.orderBy("video_id").collect()
        assert (p["dominant_emotion"], p["total_analyzed_comments"]) == ("fear", 60)
        assert (q["dominant_emotion"], q["total_analyzed_comments"]) == ("Unknown", 0)
    assert "collect_list" not in long._jdf.queryExecution().executedPlan().toString()


def test_packed_form_agrees_with_long_form(spark):
    rng = random.Random(11)
    words = ["good", "fine", "dark", "other"]
    rows = []
    for i in range(60):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8))]
        rows.append((f"p{i}", "cap", " ||| ".join(texts)))
    posts = spark.createDataFrame(rows, "video_id string, caption string, comment_text string")
    packed = C.packed_comment_emotions(posts, lexicon())
    long = C.score_comments(C.explode_comments(posts), lexicon())
    summary = C.with_comment_summary(posts, C.summarize_comments(long, lexicon().labels))
    left = {r["video_id"]: (r["dominant_emotion"], round(r["avg_emotion_confidence"], 9), r["total_analyzed_comments"],
                            round(r["joy_percentage"], 9)) for r in packed.collect()}
    right = {r["video_id"]: (r["dominant_emotion"], round(r["avg_emotion_confidence"], 9), r["total_comments"],
                             round(r["joy_percentage"], 9)) for r in summary.collect()}
    assert left == right


def test_one_post_with_most_comments(spark):
    """A hot post is reduced before the shuffle, and nothing of it is lost."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), "id")).alias("video_id"),
        F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "joy").otherwise("fear").alias("emotion"),
        F.lit(0.5).alias("confidence"), F.lit("t").alias("text"))
    summary = C.summarize_comments(rows, ["joy", "fear"])
    hot = summary.where("video_id = 'hot'").first()
    assert (hot["total_comments"], hot["dominant_emotion"]) == (20_000, "fear")
    assert "partial_count" in summary._jdf.queryExecution().executedPlan().toString()
    nested = C.nest_comments(rows, rows.select("video_id").distinct(), rows=1_000).where("video_id = 'hot'").collect()
    assert max(len(r["comments"]) for r in nested) <= 1_000 and {r["total_comments"] for r in nested} == {20_000}
    assert sum(len(r["comments"]) for r in nested) == 20_000


def test_clean_comments(spark):
    rows = [("p", i, f"comment number {i % 25}") for i in range(40)]
    rows += [("q", 0, "@user\n12K\nshort\na long enough line"), ("q", 1, "exactly 10"), ("q", 2, "a long enough line")]
    comments = spark.createDataFrame(rows, "video_id string, pos int, text string")
    kept = C.clean_comments(comments).orderBy("video_id", "pos").collect()
    assert [r["text"] for r in kept if r["video_id"] == "p"] == [f"comment number {i}" for i in range(25)]
    assert C.clean_comments(comments, limit=20).where("video_id = 'p'").count() == 20
    assert [(r["pos"], r["text"]) for r in kept if r["video_id"] == "q"] == [(0, "a long enough line")]


def test_pack_by_post(spark):
    comments = spark.createDataFrame([("p", i, f"c{i}") for i in range(25)], "video_id string, pos int, text string")
    for limit, n in ((None, 25), (20, 20)):
        row = C.pack_by_post(comments, limit).first()
        assert row["comment_text"] == " ||| ".join(f"c{i}" for i in range(n))
        assert row["comment_count_extracted"] == n


def test_full_analysis_is_row_local(spark):
    posts = spark.createDataFrame(
        [("1", "the good", "la de ||| und", 3), ("2", None, None, 1), ("3", "x", "", 2)],
        "video_id string, caption string, comment_text string, comments bigint")
    scored = full_analysis(posts, T.sentiment_scorer(), T.emotion_scorer())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    rows = {r["video_id"]: r for r in scored.collect()}
    assert rows["1"]["sentiment_label"] == "Positive" and rows["1"]["caption_emotion"] == "joy"
    assert rows["1"]["individual_comment_emotions"]["emotions"] == ["fear", "surprise"]
    assert rows["1"]["dominant_emotion"] == "fear"
    assert rows["2"]["sentiment_label"] == "Unknown" and rows["2"]["caption_emotion"] == "Unknown"
    for name, table in reports(scored).items():
        assert table.columns, name
        table.collect()
    bare = full_analysis(posts, T.sentiment_scorer(), T.emotion_scorer(), False, False)
    assert "caption_emotion" not in bare.columns and "dominant_emotion" not in bare.columns


def test_token_limit_and_batches_by_length(spark):
    """Each call gets texts of like length, cut behind the last token allowed; results stay with their rows."""
    def ends(model, text):
        return [m.end() for m in re.finditer(r"\S+", text)]

    def predict(model, texts):
        counts = [len(t.split()) for t in texts]
        assert len(texts) <= 4 and max(counts) <= 5 and counts == sorted(counts, reverse=True)
        return [{"a": 1.0 + n, "b": float(t.endswith("w4"))} for n, t in zip(counts, texts)]

    texts = [" ".join(f"w{j}" for j in range(i % 9)) for i in range(60)] + [None, "   ", "one  \n two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, caption string").coalesce(1)
    scorer = BatchScorer(lambda: 0, predict, ("a", "b"), batch_size=4, token_ends=ends, max_tokens=5)
    got = {r["i"]: r["sentiment_confidence"] for r in score_sentiment(docs, scorer).collect()}
    assert got == {i: 1.0 + min(5, len(t.split())) if t and t.strip() else 0.0 for i, t in enumerate(texts)}
    whole = BatchScorer(lambda: 0, lambda m, ts: [{"a": float(len(t.split()))} for t in ts], ("a",), token_ends=ends)
    got = {r["i"]: r["sentiment_confidence"] for r in score_sentiment(docs, whole).collect()}
    assert got[8] == 8.0 and got[62] == 2.0
    for wrong in ({"max_tokens": 3}, {"token_ends": ends, "max_tokens": 0}):
        with pytest.raises(ValueError):
            BatchScorer(lambda: 0, predict, ("a", "b"), **wrong)
