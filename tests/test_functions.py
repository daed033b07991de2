"""Column functions on small hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import counts, labels, links, records, text
from postlens.schema import STOP_WORDS

X = F.col("x")


@pytest.mark.parametrize("raw, expected", [
    ("1.2K", 1200), ("5M", 5_000_000), ("1,234", 1234), ("12k", 12_000), ("34mm", 34_000_000),
    ("5bkmk", 0), ("1.001K", 1000), ("1.2.3", 0), (".", 0), ("", 0), (None, 0), ("2B", 2_000_000_000),
    ("1,234K", 0), (" 7 ", 7), ("3dK", 0), ("99999999999999999999K", 0),
])
def test_parse_count(column, raw, expected):
    assert column([raw], counts.parse_count(X)) == [expected]


def test_metric_text_strict_and_compat(column):
    raw = ["12 likes", "34 comments", "1.2K", "1,2K", "no number", None, "5 K saves"]
    strict = column(raw, counts.parse_count(counts.metric_text(X)))
    compat = column(raw, counts.parse_count(counts.metric_text(X, compat=True)))
    assert strict == [12, 34, 1200, 12_000, 0, 0, 5000]
    assert compat[:4] == [12_000, 34_000_000, 1200, 12_000]


def test_coerce_count(column):
    raw = ["7", "abc", None, "nan", "3d", " 3 ", "1e3", "-2.5"]
    assert column(raw, counts.coerce_count(X)) == [7, 0, 0, 0, 0, 3, 1000, -2.5]


def test_round_half_even(column):
    assert column([0.0625, 0.0635, -0.0625, None], counts.round_half_even(X, 3), "double") == [
        0.062, 0.064, -0.062, None]


def test_clean_text(column):
    raw = ["See HTTP://a.b/c @émile #tag GO!!  now", None, "don't", "www.x.y é a b\x1cc", "  "]
    assert column(raw, text.clean_text(X)) == ["see go now", "", "dont", "a b c", ""]


def test_clean_text_agrees_with_a_plain_restatement(column):
    import regex
    rng = random.Random(7)
    alphabet = "abz AZ09_é#@  \n\t.http://www'ß漢"
    samples = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(200)]

    def plain(s):
        s = s.lower()
        s = regex.sub(r"(?:http|www)[^\s]+", "", s)
        s = regex.sub(r"[@#][\p{L}\p{N}_]+", "", s)
        return " ".join("".join(c for c in s if c.isspace() or (c.isascii() and c.isalpha())).split())

    assert column(samples, text.clean_text(X)) == [plain(s) for s in samples]


def test_split_and_pack(column):
    raw = ["a ||| b|||||| c ", "   ", None, " x\t|||y"]
    assert column(raw, text.split_comments(X)) == [["a", "b", "c"], [], [], ["x", "y"]]
    lists = [["one", "two words"], ["x"], []]
    again = text.split_comments(text.pack_comments(X))
    assert column(lists, again, "array<string>") == lists


def test_keywords(column):
    assert column(["New GTA 6 leak", "nothing", "", None], text.contains_any(X, ["gta 6", "leak"])) == [
        True, False, False, False]


def test_comment_body(column):
    block = "@user\n12K\n3d\nshort\na long enough line\nanother long line"
    raw = [block, "exactly 10", "12345678901K", None, "@averylonghandle"]
    assert column(raw, text.comment_body(X)) == ["a long enough line", None, None, None, None]


def test_longest_fragment(column):
    lists = [["ab", "xyz", "pqr"], [], ["", ""]]
    assert column(lists, text.longest_fragment(X, F.lit("whole")), "array<string>") == ["xyz", "whole", "whole"]


def test_tokens_and_ngrams(column):
    assert column(["alpha béta! a x_1", "solo", ""], text.tokens(X)) == [["alpha", "béta", "x_1"], ["solo"], []]
    kept = text.without("x", ["the", "don't", "back\\slash"])
    assert column([["alpha", "the", "don't"], ["back\\slash", "beta"], []], kept, "array<string>") == [["alpha"], ["beta"], []]
    assert column([["the", "red"]], text.without("x", STOP_WORDS), "array<string>") == [["red"]]
    grams = text.ngrams(X, 1, 2)
    assert column([["alpha", "beta", "gamma"], ["solo"], []], grams, "array<string>") == [
        ["alpha", "beta", "gamma", "alpha beta", "beta gamma"], ["solo"], []]
    assert column([["a1", "b1", "c1"]], text.ngrams(X, 3, 3), "array<string>") == [["a1 b1 c1"]]


def test_links(column):
    urls = ["https://h/@u/video/123?x", "https://h/x", None]
    assert column(urls, links.post_id(X)) == ["123", None, None]
    assert column(["/p", "p", "http://q"], links.absolute_url(X, "https://h")) == [
        "https://h/p", "https://h/p", "http://q"]


def test_first_non_blank(spark):
    row = spark.createDataFrame([("  ", None, " b ")], "a string, b string, c string")
    found = text.first_non_blank([F.col("a"), F.col("b"), F.col("c")])
    assert row.select(found.alias("y")).first()["y"] == "b"
    assert row.select(text.first_non_blank([F.col("a"), F.col("b")]).alias("y")).first()["y"] == ""


def test_best_class(column):
    names = ["Negative", "Neutral", "Positive"]
    best = labels.best_class(X, names)
    out = column([[0.0, 2.0, 1.0], [1.0, 1.0, 0.0], None, []], best, "array<double>")
    assert [r["label"] for r in out] == ["Neutral", "Negative", "Unknown", "Unknown"]
    assert out[0]["confidence"] == pytest.approx(0.6652409557748219)
    assert out[2]["confidence"] == 0.0


def test_records_round_trip(column):
    stored = records.records_to_json(records.comment_records(X, F.lit("2024-05-01 10:00:00"), 3))
    back = records.records_from_json(stored)
    (row,) = column([["abcdef", 'q"uote']], back, "array<string>")
    assert [r["text"] for r in row] == ["abc", 'q"u']
    assert str(row[0]["extracted_at"]) == "2024-05-01 10:00:00"
