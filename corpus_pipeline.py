"""Training-data pipeline over ``documents``: language, lines, near copies, repeated passages, packing.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``, with ``n_chars`` of the
text that they return.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from postlens.llm import langid, lines, packing, simhash, suffixes
from postlens.llm.queries import _vocabulary
from postlens.llm.store import keep

#: Of whole texts that go to a Python worker at once. Spark's 10,000 rows, or 64 MB, stand outside the heap of an executor
#: several times for each of its tasks, and once more in the worker.
BATCH_BYTES = 4 << 20


def _in_small_batches(stage):
    """``stage``, with Arrow batches of ``BATCH_BYTES`` in its session from then on, as it returns a frame that has not run yet."""
    @wraps(stage)
    def run(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _measured(rows):
    return rows.select("row.*").withColumn("n_chars", F.length("text").cast("long"))


@_in_small_batches
def language_id(spark, docs, sf_dir):
    """Documents whose language is not known go."""
    model = langid.fit_text_model(docs)
    judged = langid.identify(docs, model, declared_col="lang", host_col="source")
    return judged.where("accepted").select("row.*")


def line_dedup(spark, docs, sf_dir):
    """Repeated lines go, all documents stay."""
    return _measured(lines.dedup_lines(docs))


@_in_small_batches
def near_dedup(spark, docs, sf_dir):
    """Of documents linked by fingerprints of three-word shingles within 3 of 64 bits, the one with the smallest id stays.

    Documents without words share the zero fingerprint and are one group; a document without an id stays.
    """
    near = simhash.simhash_components(docs, shingle=3, bits=64, differences=3)
    copies = keep(near.where("doc_id <> component_id").select("doc_id").distinct(), "near_copies")
    return docs.join(copies, "doc_id", "left_anti")


@_in_small_batches
def passage_dedup(spark, docs, sf_dir):
    """Passages of 50 words or more that an earlier document has go, all documents stay."""
    return _measured(suffixes.dedup_passages(docs))


@_in_small_batches
def pack(spark, docs, sf_dir):
    """Token sequences of at most 2048 ids."""
    return packing.pack_documents(docs, _vocabulary("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in a row over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
