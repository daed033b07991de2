"""Token-id files: Simple-8b words in blocks, in a Parquet container that any store can hold.

A row of a file is a block of whole documents: ``doc_ids``, the number of ids of each (``counts``), where each begins
in ``words`` (``word_starts``), and the 64-bit words. The top four bits of a word select how many ids it holds and how
wide they are; selector 15 is an escape for one id wider than 30 bits. ``part`` and ``block`` order the blocks; ``first``
counts the ids before a block in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.memo import encoder, slices
from postlens.llm.store import texts

BLOCK_IDS = 1 << 16
SLICE_BYTES = 4_000_000
# Ids in a word, and their bits, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 30, 30, 60])
#: Bits of each id below 2**16; a zero takes one.
BIT_LENGTH = np.maximum(1, np.frexp(np.arange(1 << 16))[1]).astype(np.uint8)


def pack_ids(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for ``ids`` and the first word of each list; lists end at ``ends`` and begin a word of their own."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    bits = BIT_LENGTH[np.minimum(ids, 0xFFFF)]
    large = np.flatnonzero(ids > 0xFFFF)
    bits[large] = [int(v).bit_length() for v in ids[large]]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    left = np.repeat(ends, ends - starts) - np.arange(n)
    chosen = np.full(n, 13 if n else 0, np.uint8)
    chosen[bits > 30] = 15
    widest, span = bits, 1  # the widest of the ``span`` ids from each place
    for selector in (12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0):
        count = int(COUNTS[selector])
        grown = np.full(n, 255, np.uint8)
        if n >= count:
            m = n - count + 1
            np.maximum(widest[:m], widest[count - span:count - span + m], out=grown[:m])
        widest, span = grown, count
        fits = (widest <= WIDTHS[selector]) & (left >= count)
        chosen[fits] = selector
    hop = COUNTS[chosen].tolist()
    at, heads = 0, []
    while at < n:
        heads.append(at)
        at += hop[at]
    heads = np.array(heads, np.int64)
    picked = chosen[heads]
    words = picked.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(picked).tolist():
        rows = np.flatnonzero(picked == selector)
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        for j in range(count):
            words[rows] |= ids[heads[rows] + j] << np.uint64(j * width)
    return words, np.searchsorted(heads, starts)


def unpack_ids(words: np.ndarray) -> np.ndarray:
    """All ids of a row of words, in order."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[to[rows] + j] = (words[rows] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out


def write_token_file(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the id.

    A null or empty text has the end id alone. Null ids come first; rows of equal ids are ordered by text, and each
    keeps its own entry. An empty table gives files without blocks.
    """
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]):
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys, every = batch.column(0).to_pylist(), batch.column(1)
            for i, j in slices(pc.binary_length(every).to_pylist(), SLICE_BYTES):
                rows = [b + end for b in enc.encode(every.slice(i, j - i))]
                for a, b in slices([len(r) // 4 for r in rows], BLOCK_IDS):
                    counts = np.array([len(r) // 4 for r in rows[a:b]], np.int64)
                    ends = np.cumsum(counts)
                    words, heads = pack_ids(np.frombuffer(b"".join(rows[a:b]), "<u4"), ends)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                        "first": pa.array([first], pa.int64()), "n_ids": pa.array([int(ends[-1])], pa.int64()),
                        "doc_ids": pa.array([keys[i + a:i + b]], pa.list_(id_type)),
                        "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
                        "word_starts": pa.array([heads.tolist()], pa.list_(pa.int64())),
                        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    })
                    block, first = block + 1, first + int(ends[-1])

    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(run, f"part int, block int, first long, n_ids long, doc_ids array<{kind}>, counts array<long>, "
                                     "word_starts array<long>, words binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _per_document(spark: SparkSession, path: str, columns: str, each) -> DataFrame:
    """``each(ids of a document)`` for every document, with its place in the whole stream."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                ids = unpack_ids(words).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                found = [each(ids[e - c:e]) for e, c in zip(ends, counts, strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    "start": pa.array(row["first"] + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                } | {name: pa.array([f[k] for f in found]) for k, name in enumerate(names)})

    # One row for each part that the writer had, so the table before a part is a short one.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = blocks.mapInArrow(run, f"part int, doc_id {kind}, start long, n_tokens long, {columns}")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", *names)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: one row for each document of the files."""
    return _per_document(spark, path, "ids array<long>", lambda ids: (ids.astype(np.int64).tolist(),))


def check_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: as ``read_token_file``, with a checksum in the place of the ids."""
    return _per_document(spark, path, "ids_crc32 long", lambda ids: (zlib.crc32(ids.tobytes()),))
