"""BPE encoding and decoding by an index from each pair to all its places.

The distinct words of a slice of a partition are laid out in one row of symbols. An
index maps each active pair's rank to its places; ranks are taken in ascending order,
all places of a rank are merged from left to right, and the lists of the pairs that a
merge makes are extended. A merge only ever makes pairs of a higher rank, as its token
did not exist before, so one ascending pass gives what merging word by word gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.memo import LONG_PIECE, PLAIN, Known, byte_letters, slices, uneven
from postlens.llm.store import texts, worker_path

SLICE_CHARS = 4_000_000
#: Words and pieces of each of two generations.
REMEMBERED = 500_000
# The white space of the splitting pattern below, and that pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
        rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class PairIndexBpe:
    """Byte-level BPE from a vocabulary file (JSON) with ``vocab``, ``merges`` and ``added_tokens``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = {c: b for b, c in enumerate(byte_letters())}, spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.decimals = list(map(str, range(size)))
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.shift = size.bit_length()
        self.rank = {(a << self.shift) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.byte_rank = np.full((256, 256), -1, np.int64)
        of_id = {int(i): b for b, i in enumerate(self.byte_id)}
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if a in of_id and b in of_id:
                self.byte_rank[of_id[a], of_id[b]] = r
        self.word = regex.compile(WORD)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known, self.older = Known({"": b""}), Known()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit bytes, all words in one index."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        row = np.frombuffer(b"".join(raw), np.uint8)
        total = len(row)
        if not total:
            return [b"" for _ in words]
        ends = np.cumsum(lengths)
        ranks = np.full(total, -1, np.int64)
        ranks[:-1] = self.byte_rank[row[:-1], row[1:]]
        ranks[ends[lengths > 0] - 1] = -1
        places = np.flatnonzero(ranks >= 0)
        order = places[np.argsort(ranks[places], kind="stable")]
        of, starts = np.unique(ranks[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(of.tolist(), np.split(order, starts[1:]), strict=True)} if len(of) else {}
        symbol = self.byte_id[row].tolist() + [-1]
        after = list(range(1, total + 1)) + [total]
        before = list(range(-1, total))
        for e in ends[:-1].tolist():  # no pair reaches over the end of a word
            if e:
                after[e - 1] = total
            if e < total:
                before[e] = -1
        after[total - 1] = total
        active, rank, shift = list(index), self.rank, self.shift
        heapify(active)
        while active:
            r = heappop(active)
            a, b, made = self.left[r], self.right[r], self.made[r]
            for p in sorted(index.pop(r)):
                q = after[p]
                if symbol[p] != a or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = made, -1
                n = after[p] = after[q]
                before[n] = p
                o = before[p]
                near = []
                if o >= 0 and (x := rank.get((symbol[o] << shift) | made)) is not None:
                    near.append((x, o))
                if n < total and (x := rank.get((made << shift) | symbol[n])) is not None:
                    near.append((x, p))
                for x, at in near:
                    if x in index:
                        index[x].append(at)
                    else:
                        index[x] = [at]
                        heappush(active, x)
        ids = np.array(symbol[:-1], np.int64)
        left = ids >= 0
        upto = np.concatenate([[0], np.cumsum(left)])
        ids = ids[left].astype("<u4").tobytes()
        first = (4 * upto[ends - lengths]).tolist()
        last = (4 * upto[ends]).tolist()
        return [ids[i:j] for i, j in zip(first, last, strict=True)]

    def _split(self, piece: str) -> list[str | int]:
        if self.cut is None or not self.cut.search(piece):
            return self.word.findall(piece)
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(piece):
            out += self.word.findall(piece[at:m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.word.findall(piece[at:])

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer generation does not know: it knows them then, but for long ones, which are given back."""
        known, older, once = self.known, self.older, {}
        split: list[tuple[str, list[str | int]]] = []
        words = set()
        for p in set(pieces):
            ids = older.get(p)
            if ids is not None:  # pieces in use move on to the new generation
                known[p] = ids
                continue
            plain = PLAIN.fullmatch(p)
            parts = [x for x in plain.groups() if x] if plain else self._split(p)
            split.append((p, parts))
            words.update(w for w in parts if isinstance(w, str) and w not in known)
        new = []
        for w in words:
            ids = older.get(w)
            if ids is not None:
                known[w] = ids
            else:
                new.append(w)
        for w, ids in zip(new, self.merge(new), strict=True):
            (known if len(w) <= LONG_PIECE else once)[w] = ids
        for p, parts in split:
            if len(parts) == 1 and parts[0] == p:
                continue
            ids = b"".join([w.to_bytes(4, "little") if isinstance(w, int) else once[w] if w in once else known[w] for w in parts])
            (known if len(p) <= LONG_PIECE else once)[p] = ids
        return once

    def encode(self, slice_of: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as 32-bit bytes and as decimals, each with a comma behind it."""
        return [(raw, "".join(f"{i}," for i in np.frombuffer(raw, "<u4").tolist())) for raw in self.encode_ids(slice_of)]

    def encode_ids(self, slice_of: list[str]) -> list[bytes]:
        """For each text its ids as 32-bit bytes."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, Known({"": b""})
        known, rows, missed = self.known, [], []
        missing = known.missing = []
        for t in slice_of:
            before = len(missing)
            pieces = [t] if uneven(t) else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            rows.append(list(map(known.__getitem__, pieces)))
            missed.append(len(missing) - before)
        once = self._learn(missing)
        late = iter([once[p] if p in once else known[p] for p in missing])
        return [b"".join([next(late) if ids is None else ids for ids in row] if n else row) for row, n in zip(rows, missed, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_MODELS: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBpe(path)
    return _MODELS[path]


def _per_slice(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        every = batch.column(1).to_pylist()
        for i, j in slices([len(t) for t in every], SLICE_CHARS):
            yield batch.column(0).slice(i, j - i), every[i:j]


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for each row; null and empty texts give no ids.

    Rows are independent: repeated rows and null ids keep their own result.
    """
    def run(batches):
        bpe = model(path)
        for ids, some in _per_slice(batches):
            rows = [np.frombuffer(b, "<u4").astype(np.int32) for b in bpe.encode_ids(some)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    source = texts(df, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; a null list gives an empty text."""
    def run(batches):
        bpe = model(path)
        for batch in batches:
            rows = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    worker_path(df.sparkSession)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text; counts and digests of both, without the lists leaving the worker."""
    def run(batches):
        bpe = model(path)
        for ids, some in _per_slice(batches):
            out = [[], [], []]
            for raw in bpe.encode_ids(some):
                row = np.frombuffer(raw, "<u4").tolist()
                out[0].append(len(row))
                out[1].append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, row)).encode()).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode(row).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
