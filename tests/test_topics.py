"""Terms and topics against plain restatements."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.operators import topics as M

NO_STOPS = M.TermRules(stop_words=())


def corpus_rows(n=40, seed=2, words=("alpha", "beta", "gamma", "delta", "eps", "zeta")):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(n)]


def plain_terms(text):
    words = [w for w in text.split() if len(w) > 1]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_vocabulary(texts, n, min_docs=2, max_share=0.8):
    lists = [plain_terms(t) for t in texts if t.strip()]
    tf, df = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    able = [t for t in tf if min_docs <= df[t] <= max_share * len(lists)]
    best = sorted(able, key=lambda t: (-tf[t], t))[:n]
    return best, [df[t] for t in best], len(lists), lists


@pytest.mark.parametrize("size", [3, 7, 15, 500])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vocabulary_with_pruned_bigrams(spark, size, seed):
    rows = corpus_rows(seed=seed) + [(100, "   "), (101, None)]
    docs = spark.createDataFrame(rows, "id int, text string")
    corpus = M.build_corpus(docs, "text", size, NO_STOPS)
    best, df, n, _ = plain_vocabulary([t or "" for _, t in rows], size)
    assert (list(corpus.vocab.terms), list(corpus.vocab.doc_counts), corpus.vocab.documents) == (best, df, n)


def test_vocabulary_without_pruning_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus_rows(), "id int, text string")
    pruned = M.build_corpus(docs, "text", 12, NO_STOPS).vocab
    monkeypatch.setattr(M, "MAX_CANDIDATE_WORDS", 1)
    assert M.build_corpus(docs, "text", 12, NO_STOPS).vocab == pruned


def test_document_bounds_and_stop_words(spark):
    texts = ["alpha beta every", "alpha beta every", "alpha beta every", "solo four every", "four every x y"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["term"]: r["df"] for r in M.document_frequency(docs, "text", NO_STOPS).collect()}
    assert found == {"alpha": 3, "beta": 3, "alpha beta": 3, "beta every": 3, "four": 2, "four every": 2}
    four_of_five = spark.createDataFrame([("aa bb",), ("aa",), ("aa",), ("aa",), ("cc",)], "text string")
    assert {r["term"] for r in M.document_frequency(four_of_five, "text", NO_STOPS).collect()} == {"aa"}
    spanning = spark.createDataFrame([("red the blue",), ("red and blue",), ("green",)], "text string")
    assert "red blue" in {r["term"] for r in M.document_frequency(spanning, "text").collect()}


@pytest.mark.parametrize("size", [5, 20])
def test_tfidf_against_formula(spark, size):
    rows = corpus_rows(60, 9) + [(200, "unseenword"), (201, "  ")]
    docs = spark.createDataFrame(rows, "id int, text string")
    best, df, n, lists = plain_vocabulary([t for _, t in rows], size)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in zip(best, df)}
    expected = Counter()
    for terms in lists:
        w = {t: c * idf[t] for t, c in Counter(terms).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        for t, v in w.items():
            expected[t] += v / norm / n
    got = {r["term"]: r["tfidf_score"] for r in M.tfidf_terms(M.build_corpus(docs, "text", size, NO_STOPS)).collect()}
    assert got.keys() == expected.keys()
    for t, v in got.items():
        assert v == pytest.approx(expected[t])


def test_nothing_to_count(spark):
    for rows in ([], [("",), (None,)], [("one",)]):
        corpus = M.build_corpus(spark.createDataFrame(rows, "text string"), "text")
        assert M.tfidf_terms(corpus).count() == 0
        assert M.fit_topics(corpus) is None


def test_vocabulary_size_is_checked(spark):
    docs = spark.createDataFrame(corpus_rows(), "id int, text string")
    with pytest.raises(ValueError):
        M.build_corpus(docs, "text", M.MAX_FEATURES + 1)


def test_topics(spark):
    a, b = "apple pear plum fig", "bolt screw nail gear"
    rows = [(i, " ".join(random.Random(i).choices((a if i % 2 else b).split(), k=8))) for i in range(40)]
    rows.append((99, "unrelated thing"))
    docs = spark.createDataFrame(rows, "id int, text string")
    corpus = M.build_corpus(docs, "text", 8, M.TermRules(high=1))
    fitted = M.fit_topics(corpus, k=2, steps=10, sampling_rate=1.0)
    again = M.fit_topics(corpus, k=2, steps=10, sampling_rate=1.0)
    words = M.topic_words(fitted, 4).collect()
    assert [(r["topic_id"], r["term"]) for r in words] == [(r["topic_id"], r["term"]) for r in M.topic_words(again, 4).collect()]
    assert {frozenset(r["term"] for r in words if r["topic_id"] == t) for t in (0, 1)} == {
        frozenset(a.split()), frozenset(b.split())}
    titles = {r["topic_id"]: r["top_words"] for r in M.topic_titles(M.topic_words(fitted, 4), 2).collect()}
    assert all(len(v.split(", ")) == 2 for v in titles.values())
    mixed = M.document_topics(fitted)
    by_id = {r["id"]: r for r in mixed.collect()}
    assert len(by_id) == 41 and by_id[99]["topic_probs"] == [0.5, 0.5] and by_id[99]["dominant_topic"] == 0
    assert all(sum(r["topic_probs"]) == pytest.approx(1.0) for r in by_id.values())
    assert len({by_id[i]["dominant_topic"] for i in range(1, 40, 2)}) == 1
    assert sum(r["avg_probability"] for r in M.topic_popularity(mixed, 2).collect()) == pytest.approx(1.0)
    labels = docs.select("id", F.when(F.col("id") % 2 == 1, "odd").otherwise("even").alias("label"))
    shares = M.topics_by(mixed, labels, "label", "id").groupBy("row_label").agg(F.sum("share").alias("s")).collect()
    assert [r["s"] for r in shares] == pytest.approx([1.0, 1.0])


def test_training_settings_do_not_depend_on_size(spark):
    def settings(n):
        docs = spark.range(n).select("id", F.concat(F.lit("apple pear "), F.when(F.col("id") % 2 == 0, "plum fig").otherwise("bolt nail")).alias("text"))
        model = M.fit_topics(M.build_corpus(docs, "text", 8), k=2, steps=3).model
        return [(p.name, model.getOrDefault(p)) for p in model.params if p.name in ("maxIter", "subsamplingRate", "k")]

    assert settings(100) == settings(1000) and dict(settings(100))["subsamplingRate"] == 0.5


def test_rank_terms(spark):
    weights = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0), (1, "a", 0.5)], "topic_id int, term string, weight double")
    rows = M.rank_terms(weights, 2).orderBy("topic_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "c", 2.0), (0, 1, "a", 1.0), (1, 0, "a", 0.5)]


def test_stored_model_is_trained_once(spark, tmp_path, monkeypatch):
    rows = corpus_rows(n=30)
    trained = []
    fit = M.fit_topics
    monkeypatch.setattr(M, "fit_topics", lambda *a, **k: trained.append(1) or fit(*a, **k))

    def run(rows, **settings):
        docs = spark.createDataFrame(rows, "id int, text string")
        fitted = M.stored_topics(M.build_corpus(docs, "text", 10, NO_STOPS), str(tmp_path / "models"), k=2, steps=3, **settings)
        return {r["id"]: r["topic_probs"] for r in M.document_topics(fitted).collect()}, M.topic_words(fitted).collect()

    first = run(rows)
    assert run(list(reversed(rows))) == first and len(trained) == 1
    # A document more, a document twice, other words and other settings: each trains anew.
    run([*rows, (100, "alpha beta")])
    run([*rows, rows[0]])
    run([(i, "alpha gamma" if i == 3 else t) for i, t in rows])
    run(rows, seed=7)
    assert len(trained) == 5
    assert run(rows) == first and len(trained) == 5
    none = M.build_corpus(spark.createDataFrame([], "id int, text string"), "text", 10, NO_STOPS)
    assert M.stored_topics(none, str(tmp_path / "models"), k=2) is None


def test_a_half_written_model_is_not_read(spark, tmp_path):
    docs = spark.createDataFrame(corpus_rows(n=30), "id int, text string")
    corpus = M.build_corpus(docs, "text", 10, NO_STOPS)
    settings = {"k": 2, "steps": 3, "sampling_rate": 0.5, "seed": 42}
    half = tmp_path / M.corpus_mark(corpus, **settings) / "model"
    half.mkdir(parents=True)
    (half / "part").write_text("broken")
    assert M.stored_topics(corpus, str(tmp_path), **settings) is not None
    assert not (half / "part").exists() and M.stored_topics(corpus, str(tmp_path), **settings) is not None


def test_topic_audit_finds_faults(spark):
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 1), (3, [0.2, 0.8], 0), (4, [0.2, 0.7], 1), (5, [1.2, -0.2], 0), (6, [1.0], 0), (7, None, None)]
    docs = spark.createDataFrame(rows, "id int, topic_probs array<double>, dominant_topic int")
    got = {r["id"]: (r["proper"], r["dominant_is_largest"]) for r in M.topic_audit(docs, 2).collect()}
    assert {i for i, (proper, _) in got.items() if proper} == {1, 2, 3}
    assert {i for i, (_, largest) in got.items() if largest} == {1, 4, 5, 6}
