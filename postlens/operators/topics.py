"""Terms and topics of a document table.

A document is one row; no operator here groups by document. Per-document work
(terms, counts, norms, topic mixtures) stays in the row, and only term totals
are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import ascii_tokens, clean_text, ngrams, sql_list, without
from postlens.operators.crosstab import row_shares
from postlens.schema import STOP_WORDS
from postlens.session import materialized

# Above this many candidate words, longer terms are counted without the pre-filter.
MAX_CANDIDATE_WORDS = 50_000
# The vocabulary is fetched and sent to every task.
MAX_FEATURES = 10_000


@dataclass(frozen=True)
class TermRules:
    """Which terms a document has and which of them count."""

    low: int = 1
    high: int = 2
    min_docs: int = 2
    max_share: float = 0.8
    stop_words: tuple[str, ...] = STOP_WORDS


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent terms, bounded by ``max_features``, with document counts."""

    terms: tuple[str, ...]
    doc_counts: tuple[int, ...]
    documents: int


def with_words(docs: DataFrame, text: str, rules: TermRules = TermRules()) -> DataFrame:
    """Non-blank documents with the ``words`` of their cleaned text, stop words left out.

    Blank documents are dropped by an exploded one-element list: a filter on
    the cleaned text would be pushed below it and clean every text twice.
    """
    cleaned = docs.withColumn("_clean", clean_text(F.col(text)))
    found = cleaned.withColumn("_words", ascii_tokens(F.col("_clean")))
    found = found.withColumn("_words", without("_words", rules.stop_words))
    kept = F.when(F.col("_clean") != "", F.array("_words"))
    return found.select(*docs.columns, F.explode_outer(kept).alias("words")).where(F.col("words").isNotNull())


def with_terms(docs: DataFrame, text: str, rules: TermRules = TermRules()) -> DataFrame:
    """Adds ``terms``: the n-grams of the words left after stop-word removal."""
    return with_words(docs, text, rules).withColumn("terms", ngrams(F.col("words"), rules.low, rules.high))


def _term_totals(docs: DataFrame, terms: str) -> DataFrame:
    """(term, tf, df) over all rows, from a term list.

    Terms are sorted inside the row and paired with the term before them, so a
    term's first occurrence is known there and document frequency needs no
    distinct over (term, document). The list of earlier terms is one longer:
    the odd pair at its end has no term and counts the document.
    """
    sorted_terms = docs.select(F.sort_array(terms).alias("term"))
    earlier = F.concat(F.array(F.lit(None).cast("string")), F.col("term")).alias("earlier")
    pairs = sorted_terms.select("term", earlier).select(F.explode_outer(F.arrays_zip("term", "earlier")).alias("p"))
    first = F.when(F.col("p.term") == F.col("p.earlier"), 0).otherwise(1)
    return pairs.groupBy(F.col("p.term").alias("term")).agg(
        F.count("*").alias("tf"), F.sum(first).alias("df")
    )


def _eligible(totals: DataFrame, documents: Column, rules: TermRules) -> Column:
    return (
        F.col("term").isNotNull()
        & (F.col("df") >= rules.min_docs)
        & (F.col("df") <= documents * F.lit(rules.max_share))
    )


def document_frequency(docs: DataFrame, text: str, rules: TermRules = TermRules()) -> DataFrame:
    """(term, tf, df) of every term within the document bounds.

    The totals are written once, as the bound depends on a figure among them.
    """
    totals = materialized(_term_totals(with_terms(docs, text, rules), "terms"), "term-totals")
    documents = totals.where(F.col("term").isNull()).agg(F.max("df")).scalar()
    return totals.where(_eligible(totals, documents, rules))


def _fetch_top(totals: DataFrame, documents: int, n: int, rules: TermRules) -> list:
    kept = totals.where(_eligible(totals, F.lit(documents), rules))
    return kept.orderBy(F.desc("tf"), "term").limit(n).collect()


def vocabulary(words: DataFrame, max_features: int = 100, rules: TermRules = TermRules()) -> Vocabulary:
    """The ``max_features`` most frequent terms; equal counts in term order.

    Single words are counted first. A longer term is never more frequent than
    its words, so with ``max_features`` words found, only terms made of words at
    least as frequent as the last of them can still enter; all others are left
    out before anything is shuffled. Fetches at most ``max_features`` rows per
    pass, plus the candidate words.
    """
    if not 0 < max_features <= MAX_FEATURES:
        raise ValueError(f"max_features must lie between 1 and {MAX_FEATURES}")
    # One table serves the document count, the best words and the candidates.
    singles = materialized(_term_totals(words, "words"), "word-totals")
    documents = int(singles.where(F.col("term").isNull()).agg(F.max("df")).first()[0] or 0)
    if rules.max_share * documents < rules.min_docs:
        return Vocabulary((), (), documents)
    best = _fetch_top(singles, documents, max_features, rules) if rules.low == 1 else []
    if rules.high > 1:
        floor = best[-1]["tf"] if len(best) == max_features else rules.min_docs
        # A longer term is in no more documents than any of its words.
        able = singles.where(F.col("term").isNotNull() & (F.col("tf") >= floor) & (F.col("df") >= rules.min_docs))
        names = [r["term"] for r in able.select("term").limit(MAX_CANDIDATE_WORDS + 1).collect()]
        masked = words
        if names and len(names) <= MAX_CANDIDATE_WORDS:
            # A term with a null word is null.
            masked = words.select(F.expr(f"transform(words, w -> IF(w IN ({sql_list(names)}), w, NULL)) AS words"))
        grams = masked.select(ngrams(F.col("words"), max(2, rules.low), rules.high).alias("grams"))
        grams = grams.select(F.filter("grams", lambda g: g.isNotNull()).alias("grams"))
        longer = _fetch_top(_term_totals(grams, "grams"), documents, max_features, rules)
        best = sorted([*best, *longer], key=lambda r: (-r["tf"], r["term"]))[:max_features]
    return Vocabulary(tuple(r["term"] for r in best), tuple(r["df"] for r in best), documents)


@dataclass(frozen=True)
class Corpus:
    """Words of the documents (with the key columns), and the vocabulary."""

    words: DataFrame
    vocab: Vocabulary
    rules: TermRules

    def counts(self, out: str = "counts") -> DataFrame:
        """Key columns and a sparse vector of term counts per document."""
        terms = self.words.withColumn("_terms", ngrams(F.col("words"), self.rules.low, self.rules.high))
        counter = CountVectorizerModel.from_vocabulary(
            list(self.vocab.terms), inputCol="_terms", outputCol=out)
        return counter.transform(terms).drop("_terms", "words")


def build_corpus(docs: DataFrame, text: str, max_features: int = 100,
                 rules: TermRules = TermRules()) -> Corpus:
    """Clean the texts once, write their words to the shared folder, pick the vocabulary.

    Cleaning is by far the costliest step; the word table is read by every
    later pass (vocabulary, TF-IDF, topics). Key columns of ``docs`` are kept.
    """
    words = materialized(with_words(docs, text, rules).drop(text), "words")
    return Corpus(words, vocabulary(words, max_features, rules), rules)


_TERM_SCORES = "term string, tfidf_score double"


def tfidf_terms(corpus: Corpus) -> DataFrame:
    """Mean TF-IDF weight of each vocabulary term over all non-blank documents.

    Weight: count * (ln((1 + n) / (1 + df)) + 1), each document scaled to
    length 1. Documents without a vocabulary term count in the mean. No terms,
    no rows. Weights are scaled in the row and summed by term with a partial sum in each
    task, so at most one row per term and task is shuffled.
    """
    spark, vocab = corpus.words.sparkSession, corpus.vocab
    if not vocab.terms:
        return spark.createDataFrame([], _TERM_SCORES)
    idf = [math.log((1 + vocab.documents) / (1 + df)) + 1 for df in vocab.doc_counts]
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted").transform(corpus.counts())
    scaled = Normalizer(p=2.0, inputCol="weighted", outputCol="scaled").transform(weighted)
    weights = scaled.select(F.posexplode(vector_to_array("scaled")).alias("at", "weight")).where("weight <> 0")
    sums = weights.groupBy("at").agg(F.sum("weight").alias("total"))
    names = spark.createDataFrame(list(enumerate(vocab.terms)), "at int, term string")
    mean = F.coalesce(F.col("total"), F.lit(0.0)) / F.lit(vocab.documents)
    return names.join(sums, "at", "left").select("term", mean.alias("tfidf_score"))


def top_terms(terms: DataFrame, n: int = 20) -> DataFrame:
    return terms.orderBy(F.desc("tfidf_score"), "term").limit(n)


@dataclass(frozen=True)
class TopicModel:
    model: LDAModel
    vocab: Vocabulary
    counts: DataFrame
    k: int


def fit_topics(corpus: Corpus, k: int = 5, steps: int = 40, sampling_rate: float = 0.5,
               seed: int = 42) -> TopicModel | None:
    """Online variational LDA; None when there are fewer documents than topics or no terms.

    Each of the ``steps`` updates the topics from a draw of ``sampling_rate`` of all
    documents, whatever their number: the defaults see each document about 20
    times. A step is a job over the cluster. The count vectors are written once and
    read by every step; they hold at most one entry per vocabulary term.
    """
    if corpus.vocab.documents < k or not corpus.vocab.terms:
        return None
    counts = materialized(corpus.counts(), "topic-input")
    lda = LDA(
        featuresCol="counts", topicDistributionCol="_mixture", k=k, seed=seed, optimizer="online",
        maxIter=steps, subsamplingRate=sampling_rate, learningOffset=10.0,
        learningDecay=0.7, optimizeDocConcentration=False,
    )
    training = counts.select("counts").cache()
    try:
        return TopicModel(lda.fit(training), corpus.vocab, counts, k)
    finally:
        training.unpersist()


def corpus_mark(corpus: Corpus, **settings) -> str:
    """Name of what a model is trained on: all word lists, whatever their order, the vocabulary, the rules and the settings.

    One pass with two sums of 64-bit hashes; changed, added, lost or repeated documents give another name. Key columns
    do not count, as training does not see them.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), "words").cast("decimal(38,0)")) for seed in (1, 2)]
    content = [str(x) for x in corpus.words.agg(F.count(F.lit(1)), *sums).head()]
    told = json.dumps([content, asdict(corpus.vocab), asdict(corpus.rules), settings], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()


def stored_topics(corpus: Corpus, root: str, k: int = 5, steps: int = 40, sampling_rate: float = 0.5,
                  seed: int = 42) -> TopicModel | None:
    """The model of :func:`fit_topics`, trained only where ``root`` holds none for this corpus and these settings.

    A model lies in a folder named by its ``corpus_mark``, so changed documents train anew and old models stay. The
    vocabulary is written after the model, and a folder without it counts as empty: a job that dies while it trains or writes
    leaves nothing that is read. None, as there, for fewer documents than topics or no terms.
    """
    if corpus.vocab.documents < k or not corpus.vocab.terms:
        return None
    spark = corpus.words.sparkSession
    settings = {"k": k, "steps": steps, "sampling_rate": sampling_rate, "seed": seed}
    folder = f"{root.rstrip('/')}/{corpus_mark(corpus, **settings)}"
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/vocabulary/_SUCCESS")
    if whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        return TopicModel(LocalLDAModel.load(f"{folder}/model"), corpus.vocab, corpus.counts(), k)
    fitted = fit_topics(corpus, **settings)
    fitted.model.write().overwrite().save(f"{folder}/model")
    terms = list(zip(range(len(corpus.vocab.terms)), corpus.vocab.terms, corpus.vocab.doc_counts, strict=True))
    spark.createDataFrame(terms, "place int, term string, documents long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    return fitted


def topic_audit(documents: DataFrame, k: int) -> DataFrame:
    """Adds ``topics``, ``proper`` and ``dominant_is_largest`` to documents with a mixture.

    ``topics``: parts of the mixture. ``proper``: there are ``k``, none negative, and they add up to 1 within 1e-9.
    ``dominant_is_largest``: no part is larger than that of ``dominant_topic``, and none before it as large.
    """
    parts, at = F.col("topic_probs"), F.col("dominant_topic")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    top = F.get(parts, at)
    before = F.forall(F.slice(parts, 1, at), lambda x: x < top)
    return documents.withColumns({
        "topics": F.size(parts),
        "proper": (F.size(parts) == k) & (F.array_min(parts) >= 0) & (F.abs(total - 1) < 1e-9),
        "dominant_is_largest": F.coalesce((top == F.array_max(parts)) & before, F.lit(False)),
    })


def topic_words(fitted: TopicModel, n: int = 10) -> DataFrame:
    """Top ``n`` terms of each topic by weight; the topic matrix is k by ``max_features``."""
    spark = fitted.counts.sparkSession
    matrix = fitted.model.topicsMatrix().toArray()
    rows = [(topic, term, float(matrix[i, topic])) for topic in range(fitted.k) for i, term in enumerate(fitted.vocab.terms)]
    return rank_terms(spark.createDataFrame(rows, "topic_id int, term string, weight double"), n)


def rank_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, rank, term, weight): the ``n`` heaviest terms of each topic, from 0; equal weights in term order."""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    ranked = weights.withColumn("rank", (rank - 1).cast("int")).where(F.col("rank") < n)
    return ranked.select("topic_id", "rank", "term", "weight")


def topic_titles(words: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` terms of each topic as one text."""
    items = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return words.where(F.col("rank") < n).groupBy("topic_id").agg(
        F.array_join(F.transform(items, lambda x: x["term"]), ", ").alias("top_words")
    )


def document_topics(fitted: TopicModel) -> DataFrame:
    """Documents with ``topic_probs`` and ``dominant_topic`` (first among equals).

    A document without any vocabulary term has equal parts of all topics.
    """
    mixed = fitted.model.transform(fitted.counts).withColumn("_probs", vector_to_array("_mixture"))
    even = F.array(*[F.lit(1.0 / fitted.k)] * fitted.k)
    probs = F.when(F.array_max("_probs") > 0, F.col("_probs")).otherwise(even)
    kept = [c for c in fitted.counts.columns if c != "counts"]
    return with_dominant_topic(mixed.select(*kept, probs.alias("topic_probs")))


def with_dominant_topic(documents: DataFrame) -> DataFrame:
    """Adds ``dominant_topic``, the place of the largest of ``topic_probs`` (the first among equals)."""
    place = F.array_position("topic_probs", F.array_max("topic_probs")) - 1
    return documents.withColumn("dominant_topic", place.cast("int"))


def topic_name(index: Column) -> Column:
    return F.concat(F.lit("Topic "), (index + 1).cast("string"))


def topic_popularity(documents: DataFrame, k: int) -> DataFrame:
    """Mean probability of each topic over all documents; one partial sum per topic."""
    means = [F.avg(F.col("topic_probs")[i]) for i in range(k)]
    return documents.agg(F.array(*means).alias("m")).select(
        F.posexplode("m").alias("topic_id", "avg_probability")
    ).withColumn("topic", topic_name(F.col("topic_id")))


def topics_by(documents: DataFrame, labels: DataFrame, label: str, key: str,
              names: Sequence[str] | None = None) -> DataFrame:
    """Row shares of a label within each dominant topic; labels are matched by key."""
    topics = documents.select(key, topic_name(F.col("dominant_topic")).alias("topic"))
    return row_shares(topics.join(labels.select(key, label), key), "topic", label, names)
