"""Packing into sequences: shortest pack first, over the histogram of lengths.

Documents are cut into full pieces and a rest. Only the histogram of piece lengths, at most one row for each length,
goes to the driver. Lengths are placed from the longest to the shortest, each into the packing pattern with the least
in it; patterns carry counts, which split as lengths are placed. The patterns' places for a length are then handed to
its pieces by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.memo import encoder, slices
from postlens.llm.store import keep, texts

#: Smaller than elsewhere, for the same reason as below.
SLICE_BYTES = 1_000_000
#: Pieces of each of two generations; fewer than elsewhere, as a pipeline has other stages in the same worker processes.
REMEMBERED = 350_000


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence) with how many sequences follow each.

    A length that no open pattern has room for opens sequences that hold as many of it as fit. Every step uses a pattern
    up or ends a length, which leaves at most two new patterns and a split one, so there are at most three times as
    many patterns as lengths, whatever the counts.
    """
    heap, order, done = [], 0, []
    for length in sorted(histogram, reverse=True):
        left, back = histogram[length], []
        while left:
            if heap and heap[0][0] + length <= size:
                fill, _, pattern, count = heappop(heap)
                n = min(left, count)
                if n < count:
                    heappush(heap, (fill, order, pattern, count - n))
                    order += 1
                back.append((fill + length, pattern + [length], n))
                left -= n
            else:  # equal lengths share new sequences
                fit = size // length
                for held, n in ((fit, left // fit), (left % fit, 1)):
                    if held and n:
                        back.append((held * length, [length] * held, n))
                left = 0
            if not left or not heap or heap[0][0] + length > size:
                for fill, pattern, n in back:
                    if fill == size:
                        done.append((pattern, n))
                    else:
                        heappush(heap, (fill, order, pattern, n))
                        order += 1
                back = []
    heapify(heap)
    return done + [(pattern, n) for _, _, pattern, n in sorted(heap, key=lambda x: x[:2])]


def _slots(patterns: list[tuple[list[int], int]]):
    """For each place in a pattern: its length, the first rank it serves, how many, the first sequence, the offset."""
    served: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, served.get(length, 0), sequence, offset))
            served[length] = served.get(length, 0) + count
            offset += length
        sequence += count
    rows.sort()
    return [np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4


def cut_pieces(df: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` for each piece of each document; the end id closes a document."""
    source = texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        enc, end = encoder(tokenizer_path, REMEMBERED), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            every = batch.column(1)
            for i, j in slices(pc.binary_length(every).to_pylist(), SLICE_BYTES):
                rows = [b + end for b in enc.encode(every.slice(i, j - i))]
                take, start, length, crc, total = [], [], [], [], []
                for k, row in enumerate(rows):
                    n = len(row) // 4
                    for s in range(0, n, size):
                        piece = row[4 * s:4 * (s + size)]
                        take.append(i + k)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; no sequence holds more than ``size`` ids.

    Every id of a document, and its end id, lies in exactly one piece. A null or empty text has its end id alone. Rows
    are independent: repeated rows and null ids are packed each for itself. An empty table gives no pieces.

    Ranks within a length come from a range sort by (length, id, start), so a common length spreads over many tasks;
    the counts by task and length that link the tasks are as many as tasks and lengths together.
    """
    pieces = keep(cut_pieces(df, tokenizer_path, end_id, size, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    lengths, ranks, sequences, offsets = _slots(pack_histogram(histogram, size))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def number(batches: Iterator[pa.RecordBatch]):
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            fresh = np.flatnonzero(np.concatenate([[own[0] != last], own[1:] != own[:-1]]))
            heads = np.zeros(len(own), np.int64)
            heads[fresh] = fresh
            index = np.arange(len(own)) - np.maximum.accumulate(heads)
            index[:fresh[0] if len(fresh) else len(own)] += seen
            last, seen = int(own[-1]), int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part), pa.int32()), pa.array(index)],
                                             [*batch.schema.names, "part", "index"])

    ordered = pieces.repartitionByRange("length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    numbered = keep(ordered.mapInArrow(number, f"{fields}, part int, index long"), "numbered")
    counts = numbered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]):
        first = np.searchsorted(lengths, np.arange(size + 2))
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            slot = np.zeros(len(own), np.int64)
            for length in np.unique(own).tolist():
                a, b = first[length], first[length + 1]
                mine = own == length
                slot[mine] = a + np.searchsorted(ranks[a:b], rank[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[slot] + rank - ranks[slot]), pa.array(offsets[slot])],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = numbered.join(F.broadcast(before), ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("index")).alias("rank"))
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
