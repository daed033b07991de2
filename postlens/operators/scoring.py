"""Text scorers: text in, best label and confidence out.

A scorer is used in one of two forms. Column scorers (lexicon, batch) give a
``struct<label, confidence>`` for a text column, and the same for each element
of a list column, so a post and its packed comments are scored inside their
row. The classifier works on DataFrames, one text per row.
Blank text always gives ``Unknown`` with confidence 0.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.labels import best_class, labelled, unknown
from postlens.functions.text import TOKEN, as_text, is_blank, sql_is_blank, sql_list, sql_text, tokens
from postlens.schema import MODEL_BATCH, UNKNOWN
from postlens.session import materialized

SCORE_TYPE = "struct<label:string,confidence:double>"


class Scorer(ABC):
    """``labels`` lists every label the scorer can give, besides Unknown."""

    labels: tuple[str, ...]

    @abstractmethod
    def add_score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with a ``struct<label, confidence>`` column for a text column."""


class ColumnScorer(Scorer):
    @abstractmethod
    def score(self, text: str) -> Column:
        """Score of a named text column."""

    @abstractmethod
    def score_list(self, texts: str) -> Column:
        """Scores of a named list column, element by element."""

    def add_score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.score(text))


class LexiconScorer(ColumnScorer):
    """Sum of word weights per label; confidence is the best label's share.

    ``entries`` are (label, term, weight) with weights above 0, a small table
    that travels inside the plan (at most :attr:`MAX_TERMS` terms); use
    :class:`LexiconTableScorer` for a longer one. Ties go to the label that comes
    first in ``labels``; text without a known term gets ``default``, 0.
    """

    MAX_TERMS = 200

    def __init__(self, entries: Sequence[tuple[str, str, float]], labels: Sequence[str], default: str):
        weights: dict[str, list[float]] = {}
        for label, term, weight in entries:
            row = weights.setdefault(term, [0.0] * len(labels))
            row[list(labels).index(label)] += float(weight)
        if len(weights) > self.MAX_TERMS:
            raise ValueError(f"more than {self.MAX_TERMS} terms: use LexiconTableScorer")
        self._weights = weights
        self._order = tuple(labels)
        self._default = default
        self.labels = tuple(dict.fromkeys([*labels, default]))

    def _sql(self, text: str) -> str:
        """The score of a text expression as SQL: known words, their weights summed per
        label, then the best label and its share of the sum."""
        def array(values: Iterable[str]) -> str:
            return f"array({', '.join(values)})"

        def score(label: str, confidence: str) -> str:
            return f"named_struct('label', {label}, 'confidence', {confidence})"

        zeros = array("0D" for _ in self._order)
        table = ", ".join(
            f"{sql_text(term)}, {array(f'{w!r}D' for w in row)}" for term, row in self._weights.items())
        known = f"filter(regexp_extract_all(lower({text}), {sql_text(TOKEN)}, 0), " \
                f"t -> t IN ({sql_list(self._weights)}))"
        add = f"(sums, t) -> zip_with(sums, element_at(map({table}), t), (a, b) -> a + b)"
        best = f"{array(map(sql_text, self._order))}[int(array_position(sums, array_max(sums)) - 1)]"
        share = "array_max(sums) / reduce(sums, 0D, (a, b) -> a + b)"
        pick = f"sums -> IF(array_max(sums) > 0D, {score(best, share)}, {score(sql_text(self._default), '0D')})"
        return f"IF({sql_is_blank(text)}, {score(sql_text(UNKNOWN), '0D')}, " \
               f"reduce({known}, {zeros}, {add}, {pick}))"

    def score(self, text: str) -> Column:
        return F.expr(self._sql(f"`{text}`"))

    def score_list(self, texts: str) -> Column:
        return F.expr(f"transform(`{texts}`, x -> {self._sql('x')})")


class LexiconTableScorer(Scorer):
    """The same scores from a lexicon table (label, label_pos, term, weight) of any length.

    Each text's words are looked up in the lexicon before anything is shuffled, if it has
    at most ``MOST_BROADCAST`` entries and so can be sent to every task; Spark chooses how to
    join a longer one. Weights are then summed once per text. ``labels`` are all labels
    of the table; ``key`` identifies a text.
    """

    MOST_BROADCAST = 200_000

    def __init__(self, lexicon: DataFrame, labels: Sequence[str], default: str, key: str):
        self._lexicon = lexicon.select("label", "label_pos", "term", F.col("weight").cast("double"))
        self._order, self._default, self._key = tuple(labels), default, key
        self.labels = tuple(dict.fromkeys([*labels, default]))

    def add_score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        entries = self._lexicon.limit(self.MOST_BROADCAST + 1).count()
        lexicon = F.broadcast(self._lexicon) if entries <= self.MOST_BROADCAST else self._lexicon
        words = df.select(self._key, F.explode(tokens(F.lower(F.col(text)))).alias("term"))
        hit = [F.col("label") == x for x in self._order]
        sums = words.join(lexicon, "term").groupBy(self._key).agg(
            F.sum("weight").alias("total"), *[F.sum(F.when(h, F.col("weight"))).alias(f"w{i}") for i, h in enumerate(hit)],
            *[F.min(F.when(h, F.col("label_pos"))).alias(f"p{i}") for i, h in enumerate(hit)])
        # A label without a hit has no weight, and null sorts below every weight.
        ranked = [F.struct(F.col(f"w{i}").alias("w"), (-F.col(f"p{i}")).alias("p"), F.lit(x).alias("label")) for i, x in enumerate(self._order)]
        best = F.array_max(F.array(*ranked))
        scores = sums.where(F.col("total") > 0).select(self._key, labelled(best["label"], best["w"] / F.col("total")).alias("_hit"))
        missed = labelled(F.lit(self._default), F.lit(0.0))
        score = F.when(is_blank(F.col(text)), unknown()).otherwise(F.coalesce("_hit", missed))
        return df.join(scores, self._key, "left").withColumn(out, score).drop("_hit")


def _loaded(name: str, load: Callable[[], Any]) -> Any:
    """A scorer's model in this process. The cache hangs on a module of the worker
    itself, as a function that was sent to it brings globals of its own."""
    cache = vars(uuid).setdefault("_postlens_models", {})
    if name not in cache:
        cache.clear()
        cache[name] = load()
    return cache[name]


class BatchScorer(ColumnScorer):
    """A user's model, such as a pretrained network, run in Arrow batches.

    ``load()`` is called once per Python worker process; ``predict(model, texts)``
    gets at most ``batch_size`` texts and returns, for each, the class scores
    by label. Only the text column is sent to Python. Texts are whole, or cut at
    ``max_chars`` where the model cannot take more. A loaded model stays with its
    worker process: all columns and tasks that use one scorer there share it.

    ``token_ends(model, text)`` gives the place behind each token of a text, in ascending
    order, as the model's own tokeniser finds them. With ``max_tokens`` a text ends behind its
    token of that number, as for a network with a token limit; what comes after is not seen.
    Texts of an Arrow batch are handed over by falling length, in tokens if they are known, so that
    those of one call need little padding; each result goes back to its own row.
    """

    def __init__(self, load: Callable[[], Any],
                 predict: Callable[[Any, list[str]], list[dict[str, float]]],
                 labels: Sequence[str], batch_size: int = MODEL_BATCH,
                 max_chars: int | None = None,
                 token_ends: Callable[[Any, str], Sequence[int]] | None = None,
                 max_tokens: int | None = None):
        if max_tokens is not None and (token_ends is None or max_tokens < 1):
            raise ValueError("max_tokens needs token_ends and must be 1 or more")
        self.labels = tuple(labels)
        self._name = uuid.uuid4().hex
        self._load, self._predict = load, predict
        self._batch, self._chars = batch_size, max_chars
        self._ends, self._tokens = token_ends, max_tokens

    def _best(self) -> Callable[[Any, list[str]], list[tuple[str, float]]]:
        predict, size, chars = self._predict, self._batch, self._chars
        token_ends, most = self._ends, self._tokens

        def seen(model: Any, text: str) -> tuple[int, str]:
            """Length, and the part of the text that the model sees."""
            text = text[:chars]
            if token_ends is None:
                return len(text), text
            ends = token_ends(model, text)
            if most is None or len(ends) <= most:
                return len(ends), text
            return most, text[:ends[most - 1]]

        def best(model: Any, texts: list[str]) -> list[tuple[str, float]]:
            out = [(UNKNOWN, 0.0)] * len(texts)
            live = [(i, *seen(model, t)) for i, t in enumerate(texts) if t and t.strip()]
            live.sort(key=lambda x: -x[1])
            for start in range(0, len(live), size):
                part = live[start:start + size]
                for (i, _, _), scores in zip(part, predict(model, [t for _, _, t in part]), strict=True):
                    label = max(scores, key=scores.__getitem__)
                    out[i] = (label, float(scores[label]))
            return out

        return best

    def score(self, text: str) -> Column:
        load, best, name = self._load, self._best(), self._name

        @F.pandas_udf(SCORE_TYPE)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = _loaded(name, load)
            for texts in batches:
                yield pd.DataFrame(best(model, texts.tolist()), columns=["label", "confidence"])

        return run(F.col(text))

    def score_list(self, texts: str) -> Column:
        load, best, name = self._load, self._best(), self._name

        @F.pandas_udf(f"array<{SCORE_TYPE}>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(name, load)
            for lists in batches:
                rows = [list(x) if x is not None else [] for x in lists]
                scored = iter(best(model, [t for row in rows for t in row]))
                yield pd.Series([
                    [{"label": label, "confidence": c} for label, c in (next(scored) for _ in row)]
                    for row in rows
                ])

        return run(F.col(texts))


class ClassifierScorer(Scorer):
    """A fitted multinomial classifier over hashed word counts."""

    def __init__(self, model: PipelineModel, labels: Sequence[str]):
        self._model, self.labels = model, tuple(labels)

    @classmethod
    def fit(cls, labelled_texts: DataFrame, text: str, label: str, labels: Sequence[str],
            features: int = 1 << 14, max_iter: int = 10) -> ClassifierScorer:
        """Train on rows whose ``label`` is one of ``labels``; no vocabulary is fetched."""
        names = F.array(*[F.lit(x) for x in labels])
        rows = labelled_texts.select(
            tokens(F.lower(as_text(F.col(text)))).alias("_words"),
            (F.array_position(names, F.col(label)) - 1).cast("double").alias("_target"),
        ).where(F.col("_target") >= 0)
        hashing = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features)
        logistic = LogisticRegression(
            featuresCol="_features", labelCol="_target", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_prediction", family="multinomial",
            maxIter=max_iter, regParam=0.01,
        )
        # The optimizer reads this table once per step.
        table = materialized(hashing.transform(rows).select("_features", "_target"), "classifier-input")
        return cls(PipelineModel(stages=[hashing, logistic.fit(table)]), labels)

    def add_score(self, df: DataFrame, text: str, out: str) -> DataFrame:
        scored = self._model.transform(df.withColumn("_words", tokens(F.lower(as_text(F.col(text))))))
        scored = scored.withColumn("_scores", vector_to_array("_probability"))
        best = best_class(F.col("_scores"), self.labels, softmax=False)
        return scored.withColumn(
            out, F.when(is_blank(F.col(text)), unknown()).otherwise(best)
        ).select(*df.columns, out)


def score_text(df: DataFrame, text: str, scorer: Scorer, label: str, confidence: str) -> DataFrame:
    """``df`` with a label and a confidence column for a text column."""
    scored = scorer.add_score(df, text, "_score")
    return scored.withColumns({
        label: F.col("_score.label"), confidence: F.col("_score.confidence"),
    }).drop("_score")


def score_sentiment(df: DataFrame, scorer: Scorer, text: str = "caption") -> DataFrame:
    return score_text(df, text, scorer, "sentiment_label", "sentiment_confidence")
