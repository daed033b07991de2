"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimiser positions: where the hash of four words is the least of some window of 17. Each window of 50
words belongs to the first of its least minimisers, which stands among its first 17 words, so a suffix is followed by at least 34
words of each of its windows. Suffixes whose first 34 words occur in one document only are left out; the others
are sorted over all tasks by those words, by the words behind them and by the words before them, and compared with their
neighbours. A suffix that agrees with an earlier document's on all words its windows reach to the left and right is settled
there. The first of each such run is extended word by word instead: each of its windows meets the windows with as many
of the same words to the left and right, so a passage that shares an edge with a commoner one is not lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.memo import slices
from postlens.llm.store import forget, keep, same, worker_path

WORDS = 50
GRAM = 4
WINDOW = 17
REACH = WORDS - WINDOW + 1
SLOTS = 1 << 25
SLICE_BYTES = 4_000_000
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
WORD = re.compile("[^\t-\r ]+")
SUFFIX = ["key", "check", "after", "before", "low", "high", "id", "of", "at"]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word; words end at ASCII white space."""
    return np.array([xxhash.xxh64_intdigest(w) for w in text.encode().split()], np.uint64)


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    up, down = _power(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return _mix((sums[size:] - sums[:-size]) * down[:len(sums) - size])


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept suffixes, the hash of their first 34 words, and how far left of them their windows start at least and at most."""
    if len(hashes) < WORDS:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    starts = np.arange(len(hashes) - WORDS + 1)
    least = np.lib.stride_tricks.sliding_window_view(_rolling(hashes, GRAM), WINDOW)[:len(starts)].argmin(axis=1) + starts
    first = np.flatnonzero(np.diff(least, prepend=-1))
    at = least[first]
    last = np.append(first[1:], len(starts)) - 1
    return at, _rolling(hashes, REACH)[at].view(np.int64), at - last, at - first


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    worker_path(df.sparkSession)
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"),
                     F.xxhash64(F.col(id_col), F.col(text_col)).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _flagged(df: DataFrame, name: str, held: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: where it is false, no row of ``held`` has the same hash ``name``; where it is true, one may have it.

    A bit for each of 2^25 slots tells it, 64 bits in a row, so at most 524,288 rows are broadcast, however many ``held`` has.
    """
    slot = F.col(name).bitwiseAND(SLOTS - 1)
    bits = held.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("slots")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    found = df.join(F.broadcast(bits), F.shiftright(slot, 6) == F.col("slots"), "left")
    return found.withColumn("maybe", F.coalesce(F.bit_get("bits", slot.bitwiseAND(63).cast("int")) == 1, F.lit(False))).drop("slots", "bits")


def _parts(batches: Iterator[pa.RecordBatch]):
    """The rows of some MB of ``text`` at a time, so that a worker's memory does not follow the length of texts."""
    for batch in batches:
        for i, j in slices(pc.binary_length(batch.column("text")).to_pylist(), SLICE_BYTES):
            yield batch.slice(i, j - i)


def _suffixes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _parts(batches):
            take, places, keys = [], [], []
            for k, t in enumerate(batch.column("text")):
                at, key, _, _ = minimisers(word_hashes(t.as_py()))
                take.append(np.full(len(at), k))
                places.append(at)
                keys.append(key)
            if take:
                index = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("id").take(index), batch.column("of").take(index),
                                                  pa.array(np.concatenate(places).astype(np.int32))], ["key", "id", "of", "at"])

    return docs.select("id", "of", "text").mapInArrow(run, "key long, id long, of long, at int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each suffix of ``wanted(id, of, wanted)`` with what its windows hold: its first 34 words (two hashes), the words after them, those before it from the nearest."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _parts(batches):
            take, before, after, numbers = [], [], [], []
            for k, (t, w) in enumerate(zip(batch.column("text"), batch.column("wanted"), strict=True)):
                hashes = word_hashes(t.as_py())
                at, key, low, high = minimisers(hashes)
                some = np.isin(at, w.values.to_numpy())
                at, key, low, high = at[some], key[some], low[some], high[some]
                check = _rolling(_mix(hashes + np.uint64(1)), REACH)[at].view(np.int64)
                take.append(np.full(len(at), k))
                numbers.append((key, check, at, low, high))
                words = (_mix(hashes) >> np.uint64(32)).astype(">u4")
                ahead, back, n = words.tobytes(), words[::-1].tobytes(), len(words)
                before += [back[4 * (n - p):4 * (n - p + h)] for p, h in zip(at.tolist(), high.tolist(), strict=True)]
                after += [ahead[4 * (p + REACH):4 * (p + WORDS - x)] for p, x in zip(at.tolist(), low.tolist(), strict=True)]
            if take:
                index = pa.array(np.concatenate(take))
                key, check, at, low, high = (np.concatenate(x) for x in zip(*numbers, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(check), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(low.astype(np.int32)),
                     pa.array(high.astype(np.int32)), batch.column("id").take(index), batch.column("of").take(index), pa.array(at.astype(np.int32))], SUFFIX)

    by_doc = wanted.select(F.col("id").alias("in_id"), F.col("of").alias("in_of"), "wanted")
    some = _flagged(docs.select("id", "of", "text"), "of", wanted).where("maybe")
    found = some.join(by_doc, same(F.col("id"), F.col("in_id")) & (F.col("of") == F.col("in_of")))
    return found.select("id", "of", "text", "wanted").mapInArrow(
        run, "key long, check long, after binary, before binary, low int, high int, id long, of long, at int")


def _changes(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows that differ from the one before them in one of the columns; the first one does."""
    out = np.zeros(len(rows), bool)
    for name in names:
        c = rows.column(name)
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    out[0] = True
    return out


def neighbours(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compares sorted suffixes: ``head`` and ``own`` of each row, and the rows ``paired`` and ``open``.

    ``head`` is the first row with the same words around it, ``own`` tells whether that is of the same document; a row that is
    not ``own`` is settled. ``paired`` are heads that are settled by the row behind them, as all suffixes that start with
    their 34 words agree on the words around; ``open`` rows have to be extended: other heads, further places of
    their document, and for each head a row of another document.
    """
    at = np.arange(len(rows))
    starts, runs = _changes(rows, ["key"]), _changes(rows, SUFFIX[:6])
    head = np.maximum.accumulate(np.where(runs, at, 0))
    ids, ofs = (rows.column(c).fill_null(0).to_numpy() for c in ("id", "of"))
    own = (ids == ids[head]) & (ofs == ofs[head])
    group = np.cumsum(starts) - 1
    alone = (np.bincount(group, runs) == 1) & (np.bincount(group, own) == 1)
    alone[[0, -1]] = False  # may go on outside
    late = np.flatnonzero(~own)
    second = late[np.unique(head[late], return_index=True)[1]]
    paired = head[second[alone[group[second]]]]
    wide = own.copy()
    wide[second] = True
    return head, own, paired, np.flatnonzero(wide & ~alone[group])


def _settled(contexts: DataFrame) -> DataFrame:
    """``extra, other`` of suffixes that their neighbours settle; those that have to be extended keep ``key, check, after, before``."""
    def run(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            head, own, paired, wide = neighbours(rows)
            late = np.flatnonzero(~own)
            settled = np.concatenate([late, paired])
            ids = rows.column("id")
            n, m = len(settled), len(wide)
            take = pa.array(np.concatenate([settled, wide]))
            extra = pa.concat_arrays([pa.array(np.arange(n) < len(late)), pa.nulls(m, pa.bool_())])
            other = pa.concat_arrays([ids.take(pa.array(head[late])), ids.take(pa.array(paired + 1)), pa.nulls(m, pa.int64())])
            around = [pa.concat_arrays([pa.nulls(n, rows.column(c).type), rows.column(c).take(pa.array(wide))]) for c in SUFFIX[:4]]
            yield pa.RecordBatch.from_arrays([*around, *(rows.column(c).take(take) for c in SUFFIX[4:]), extra, other], [*SUFFIX, "extra", "other"])
            last = rows.slice(int(head[-1]), 1)

    ordered = contexts.repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)
    return ordered.mapInArrow(run, "key long, check long, after binary, before binary, low int, high int, id long, of long, at int, extra boolean, other long")


def _extended(wide: DataFrame) -> DataFrame:
    """``id, of, start, stop, extra, other`` of the windows around suffixes that another document has too."""
    left, right = F.expr("substring(before, 1, 4 * o)"), F.expr(f"substring(after, 1, 4 * ({WINDOW - 1} - o))")
    windows = wide.select("id", "of", "at", "key", "check", "before", "after", F.explode(F.sequence("low", "high")).alias("o")).select(
        "id", "of", (F.col("at") - F.col("o")).alias("start"),
        F.xxhash64("key", "check", "o", left, right).alias("w1"), F.xxhash64(right, left, "o", "check", "key").alias("w2"))
    doc = F.struct("id", "of")
    held = windows.groupBy("w1", "w2").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).where(~same(F.col("least"), F.col("most")))
    is_first = same(F.col("id"), F.col("least.id")) & (F.col("of") == F.col("least.of"))
    return windows.join(held, ["w1", "w2"]).select("id", "of", "start", (F.col("start") + WORDS).alias("stop"), (~is_first).alias("extra"),
                                                   F.when(is_first, F.col("most.id")).otherwise(F.col("least.id")).alias("other"))


def merge_spans(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Spans of 50 words or more after those that meet are made one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, stops, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= WORDS]


def _spans(found: list[dict]) -> list[dict]:
    return [{"start": s, "stop": e} for s, e in merge_spans([x["start"] for x in found], [x["stop"] for x in found])]


def _per_document(found: DataFrame) -> DataFrame:
    """``id, of, repeated, extra`` (spans of words) ``, others`` from ``found(id, of, start, stop, extra, other)``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            repeated, extra = ([_spans(x) for x in batch.column(c).to_pylist()] for c in ("shared", "late"))
            others = [sorted(x) for x in batch.column("others").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("of"), pa.array(repeated, kind), pa.array(extra, kind),
                                              pa.array(others, pa.list_(pa.int64()))], ["id", "of", "repeated", "extra", "others"])

    place = F.struct("start", "stop")
    listed = found.groupBy("id", "of").agg(F.collect_list(place).alias("shared"), F.collect_list(F.when(F.col("extra"), place)).alias("late"),
                                           F.collect_set("other").alias("others"))
    span = "array<struct<start: int, stop: int>>"
    return listed.mapInArrow(run, f"id long, of long, repeated {span}, extra {span}, others array<long>")


def _passages(docs: DataFrame) -> DataFrame:
    suffixes = _suffixes(docs)
    shared = keep(suffixes.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key"), "shared_suffixes")
    # What no other document can have stays where it is; the joins are exact.
    some = _flagged(suffixes, "key", shared).where("maybe").join(shared, "key", "left_semi")
    wanted = keep(some.groupBy("id", "of").agg(F.collect_list("at").alias("wanted")), "wanted_suffixes")
    forget(shared)
    settled = keep(_settled(_contexts(docs, wanted)), "settled_suffixes")
    forget(wanted)
    whole = settled.where("extra is not null").select("id", "of", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + WORDS).alias("stop"), "extra", "other")
    found = keep(_per_document(whole.unionByName(_extended(settled.where("extra is null")))), "passages")
    forget(settled)
    return found


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_spans, n_words, spans, extra_spans, other_ids`` for each document with a passage of 50 words or more that another document has.

    Words end at ASCII white space and count from 0; a span stops before ``stop``. ``extra_spans`` are those that an earlier
    document (by id, then hash of the text) has; ``other_ids`` names documents that share a span, not all that do. Passages
    repeated in one document only do not count. A window's first 34 words are compared by 128 bits of hashes, each other word by 32. Null and empty
    texts have no passages; rows equal in id and text are one document; a null id sorts first. An empty table gives no rows.
    """
    found = _passages(_rows(df, id_col, text_col))
    words = F.aggregate("repeated", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), F.size("repeated").cast("long").alias("n_spans"), words.cast("long").alias("n_words"),
                        F.col("repeated").alias("spans"), F.col("extra").alias("extra_spans"), F.col("others").alias("other_ids"))


def cut_passages(text: str, spans: list[dict]) -> str:
    """``text`` without the words of ``spans`` and the white space behind them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at:starts[s["start"]]])
        at = starts[s["stop"]]
    return "".join([*out, text[at:]])


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``: each row of ``df``, with the passages that an earlier document has taken out of its text.

    See ``repeated_passages``. All rows stay; one that loses all its words has an empty text. A null text stays null.
    """
    docs = _rows(df, id_col, text_col)
    found = _passages(docs).where(F.size("extra") > 0).select("id", "of", "extra")
    flagged = _flagged(docs.select("row", "id", "of"), "of", found)
    spans = found.select(F.col("id").alias("in_id"), F.col("of").alias("in_of"), "extra")
    joined = flagged.where("maybe").join(spans, same(F.col("id"), F.col("in_id")) & (F.col("of") == F.col("in_of")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_passages(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    old = F.col(f"row.`{text_col}`")
    text = F.when(old.isNotNull(), cut(F.coalesce(old, F.lit("")), "extra"))
    changed = joined.select(F.col("row").withField(f"`{text_col}`", text).alias("row"))
    return flagged.where(~F.col("maybe")).select("row").unionByName(changed)
