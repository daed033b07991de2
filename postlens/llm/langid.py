"""Language identification by Bayesian evidence fusion.

A naive Bayes model over hashed character trigrams gives the likelihood of a whole text in each language. It is combined
with what the markup declares, by how often that declaration goes with each language, and with a prior of the host, which is
smoothed towards that of the address suffix, and that towards the prior of the whole table. Declarations and priors are
grouped sums of the texts' own posteriors over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import memo
from postlens.llm.store import keep, worker_path

BUCKETS = 1 << 14
#: Rows of the sample that the text model is fitted on, about.
SAMPLE_ROWS = 4000
#: Trigrams of one text repeat each other's evidence: a text counts as at most so many.
TRUSTED = 100
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT, DECLARED_RIGHT = 20.0, 100.0, 50.0, 0.9
LEAST_CONFIDENCE = 0.5
MOST_BROADCAST = 200_000


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of letters; a text without letters has none."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le"), "<u4")
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, codes, 32)
    c = c[(c != 32) | np.concatenate([[False], c[1:] != c[:-1]])]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18)).astype(np.int64)


class TextModel:
    """Log probability of each bucket in each language; ``languages`` in alphabetical order."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy()

    def likelihood(self, text: str) -> list[float] | None:
        """Log likelihoods less their log sum; null without letters, or where even chance explains the text better."""
        grams = trigrams(text)
        if not len(grams):
            return None
        if len(grams) < 4096:
            mean = self.table[grams].mean(axis=0)
        else:
            mean = np.bincount(grams, minlength=BUCKETS) @ self.table / len(grams)
        if mean.max() < -np.log(BUCKETS):
            return None
        fit = mean * min(len(grams), TRUSTED)
        return (fit - fit.max() - np.log(np.exp(fit - fit.max()).sum())).tolist()


def fit_text_model(df: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS, seed: int = 5) -> TextModel:
    """Trigram counts by label over a sample of about ``rows`` labelled rows, whole texts; summed by Spark.

    The driver gets at most the number of labels times the number of buckets.
    """
    worker_path(df.sparkSession)
    labelled = df.select(F.lower(F.col(label_col).cast("string")).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    total = labelled.count()
    some = labelled.sample(fraction=min(1.0, rows / total), seed=seed) if total > rows else labelled

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(text)
                if label not in sums:
                    sums[label] = np.zeros(BUCKETS, np.int64)
                sums[label] += np.bincount(grams, minlength=BUCKETS)
        for label, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"])

    rows_of = some.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows_of["label"].unique())
    counts = np.zeros((max(1, len(languages)), BUCKETS))
    counts[rows_of["label"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), rows_of["bucket"].to_numpy(dtype=int)] = rows_of["n"]
    return TextModel(languages or ["und"], counts)


def _sums(size: int) -> list[Column]:
    return [F.sum(F.exp(F.col("fit")[i])).alias(f"n{i}") for i in range(size)]


def _array(size: int, of) -> Column:
    return F.array(*(of(i) for i in range(size)))


def identify(df: DataFrame, model: TextModel, text_col: str = "text", declared_col: str | None = None, host_col: str | None = None,
             suffix_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """``row`` (or ``id_col`` alone, if given), ``language, confidence, text_language, accepted``.

    Evidence that a row lacks (a null, a column not named, a declaration that is no language code) is left out. A row is
    accepted if its text holds letters, chance does not explain it better than every language, and the best
    language has a confidence of 0.5 or more; else ``language`` is ``und``, with confidence 0. Null and empty texts are not
    accepted. Of equal languages the first by name wins. Rows are independent but for priors and declarations;
    repeated rows count each. An empty table gives no rows.
    """
    worker_path(df.sparkSession)
    languages, size = model.languages, len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    @F.pandas_udf("array<double>")
    def fit(text: pd.Series) -> pd.Series:
        memo.release()  # worker processes serve one kind of stage after another
        m = shared.value
        return pd.Series([None if t is None else m.likelihood(t) for t in text], dtype=object)

    def named(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.lower(F.col(f"`{name}`").cast("string"))

    code = F.regexp_extract(named(declared_col), "^([a-z]{2,3})(?:[-_]|$)", 1)
    kept = F.col(f"`{id_col}`").alias("row") if id_col else F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(kept, F.when(code != "", code).alias("declared"), named(host_col).alias("host"), named(suffix_col).alias("suffix"),
                     fit(F.col(f"`{text_col}`").cast("string")).alias("fit"))
    evidence = keep(rows if id_col else rows.drop("row"), "evidence")
    fitted = evidence.where("fit is not null")
    hosts = keep(fitted.groupBy("host", "suffix").agg(*_sums(size)), "host_sums")
    suffixes = keep(hosts.groupBy("suffix").agg(*(F.sum(f"n{i}").alias(f"s{i}") for i in range(size))), "suffix_sums")
    totals = suffixes.agg(*(F.sum(f"s{i}") for i in range(size))).head()
    total = np.array([x or 0.0 for x in totals]) + 1.0
    total = (total / total.sum()).tolist()

    def smoothed(prefix: str, weight: float, towards) -> list[Column]:
        everything = sum((F.col(f"{prefix}{i}") for i in range(1, size)), F.col(f"{prefix}0"))
        return [(F.col(f"{prefix}{i}") + F.lit(weight) * towards(i)) / (everything + F.lit(weight)) for i in range(size)]

    of_suffix = suffixes.select(F.col("suffix").alias("of_suffix"), *(c.alias(f"p{i}") for i, c in enumerate(smoothed("s", SUFFIX_WEIGHT, lambda i: F.lit(total[i])))))
    of_host = hosts.join(of_suffix, F.col("suffix").eqNullSafe(F.col("of_suffix"))).select(
        F.col("host").alias("of_host"), F.col("suffix").alias("in_suffix"), F.array(*(F.log(c) for c in smoothed("n", HOST_WEIGHT, lambda i: F.col(f"p{i}")))).alias("prior"))
    of_host = keep(of_host, "host_priors")
    # Codes have two or three letters, so there are a bounded number of declarations.
    declared = fitted.where("declared is not null").groupBy("declared").agg(*_sums(size))
    everything = fitted.where("declared is not null").agg(*(F.sum(F.exp(F.col("fit")[i])) for i in range(size))).head()
    right = [F.when(F.col("declared") == x, F.lit(DECLARED_RIGHT)).otherwise(F.lit((1 - DECLARED_RIGHT) / max(1, size - 1))) for x in languages]
    of_declared = keep(declared.select(F.col("declared").alias("of_declared"), _array(size, lambda i: F.log(
        (F.col(f"n{i}") + DECLARED_WEIGHT * right[i]) / (F.lit(everything[i] or 0.0) + DECLARED_WEIGHT))).alias("says")), "declared_fits")

    source = evidence if id_col else rows
    few = of_host.count() <= MOST_BROADCAST
    joined = source.join(F.broadcast(of_host) if few else of_host, F.col("host").eqNullSafe(F.col("of_host")) & F.col("suffix").eqNullSafe(F.col("in_suffix")), "left") \
        .join(F.broadcast(of_declared), F.col("declared") == F.col("of_declared"), "left")
    none = F.array(*[F.lit(0.0)] * size)
    prior = F.coalesce("prior", F.array(*(F.lit(float(np.log(x))) for x in total)))
    fused = _array(size, lambda i: F.col("fit")[i] + prior[i] + F.coalesce("says", none)[i])
    best = F.array_max("fused")
    names = F.array(*map(F.lit, languages))
    confidence = 1 / F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    judged = joined.select("row", "fit", fused.alias("fused")).select(
        "row", F.element_at(names, F.array_position("fused", best).cast("int")).alias("best"), confidence.alias("sure"),
        F.element_at(names, F.array_position("fit", F.array_max("fit")).cast("int")).alias("text_language"))
    accepted = F.coalesce(F.col("sure") >= LEAST_CONFIDENCE, F.lit(False))
    return judged.select("row", F.when(accepted, F.col("best")).otherwise("und").alias("language"), F.when(accepted, F.col("sure")).otherwise(0.0).alias("confidence"),
                         F.coalesce("text_language", F.lit("und")).alias("text_language"), accepted.alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_id, text, declared, host, suffix`` from raw pages: the text between tags, the markup's language, the address."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1))
    return pages.select("page_id", bare.alias("text"), F.regexp_extract(html, "(?i)<html[^>]*\\slang=[\"']?([A-Za-z-]+)", 1).alias("declared"),
                        host.alias("host"), F.regexp_extract(host, "([^.]+)$", 1).alias("suffix"))
