"""Whole texts through a tokenizers file, with the ids of repeated pieces remembered.

White space separates pieces whose ids do not depend on each other, so a text's ids
are those of its pieces in a row. A process remembers the ids of pieces it has seen,
up to a fixed number; texts where the cut would not be exact are encoded whole.
The pieces of a slice of texts are cut and told apart as Arrow columns, so only its
distinct pieces become Python strings.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of each of two generations.
REMEMBERED = 700_000
LONG_PIECE = 64
#: Latin letters that stay one letter when a file composes or lower-cases them.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
#: A word of such letters, and marks behind it that are split from it. An apostrophe is none, as it may begin an ending.
MARKS = ".,;:!?%#*()+=/\"-"
PLAIN = re.compile(f"( ?{LETTER}+)([{MARKS}]*)")
#: White space other than single spaces and line ends, or two in a row: such a text is not cut for a byte-level file.
UNEVEN = re.compile("[\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]")


#: The same in a text of ASCII only.
UNEVEN_ASCII = ("\0", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "  ", "\n\n", " \n", "\n ")


#: Bytes without which, and without two of space or line end in a row, no text is uneven: those above, and first bytes of the other white space.
SUSPECT = np.zeros(256, bool)
SUSPECT[[*(ord(x) for x in UNEVEN_ASCII if len(x) == 1), 0xC2, 0xE1, 0xE2, 0xE3]] = True

ASCII_LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
ASCII_LETTER[list(string.ascii_letters.encode())] = MARK[list(MARKS.encode())] = True


def uneven(text: str) -> bool:
    if text.isascii():
        return any(x in text for x in UNEVEN_ASCII)
    return "\0" in text or UNEVEN.search(text) is not None


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary file, by byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


BYTE_LETTERS = dict(enumerate(byte_letters()))


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    A piece that is one plain word needs no normalising or splitting, so it goes to the file's model at once; whether that
    is so for a file is tried out on each letter when it is loaded.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A file that drops white space gives a space no id; one that keeps it ties it to the word behind it.
        self.drops_space = not self.tokenizer.encode("a b", add_special_tokens=False).tokens[1].startswith("\u0120") \
            and not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.lowers = self._whole(["A"]) == self._whole(["a"])
        letters = [c for c in map(chr, range(0x250)) if re.fullmatch(LETTER, c)]
        probes = [w for c in letters for w in (c, f"th{c}er", *([] if self.drops_space else [f" {c}", f" wo{c}"]))]
        self.plain = [self._word(w) for w in probes] == self._whole(probes)
        marked = [f"wo{c}.{m}" for c in letters[::40] for m in ("", ",", '")', "!?", "###", "-(", "b", "3", "'s")]
        self.marks = self.plain and [a + b for a, b in zip(self._whole([w[:3] for w in marked]), self._whole([w[3:] for w in marked]), strict=True)] \
            == self._whole(marked)
        self.seen, self.older = Known({"": b""}), Known()

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts in a row, with the spaces or line ends that begin them, and the number of pieces before each text and at the end.

        Marks behind a letter begin a piece too, if the file splits them off.
        """
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        ends = offsets - offsets[0]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        line_end = raw == 10
        white = line_end | (raw == 32)
        begins = np.append(white, True)
        begins[ends] = True
        if self.marks:
            begins[1:-1] |= ASCII_LETTER[raw[:-1]] & MARK[raw[1:]]
        if not self.drops_space:
            begins[1:][line_end] = True
            suspect = SUSPECT[raw]
            suspect[1:] |= white[1:] & white[:-1]
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(suspect), side="right") - 1).tolist():
                i, j = int(ends[k]), int(ends[k + 1])
                if uneven(raw[i:j].tobytes().decode()):
                    begins[i + 1:j] = False
        cuts = np.flatnonzero(begins)
        return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)), np.searchsorted(cuts, ends)

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        elif word[0] == " ":
            word = BYTE_LETTERS[32] + word[1:]
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _remember(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer generation does not know: it knows them then, but for long ones, which are given back."""
        seen, older, once = self.seen, self.older, {}
        words, marked, others = [], [], set()
        for p in set(pieces):
            known = older.get(p)
            if known is not None:  # pieces in use move on to the new generation
                seen[p] = known
                continue
            split = PLAIN.fullmatch(p) if self.plain else None
            if split and not split[2]:
                words.append(p)
            elif split and self.marks:
                marked.append(split)
                if split[1] not in seen:
                    words.append(split[1])
                if split[2] not in seen:
                    others.add(split[2])
            else:
                others.add(p)

        def note(p: str, ids: bytes) -> None:
            (seen if len(p) <= LONG_PIECE else once)[p] = ids

        for p in words:
            if p not in seen:
                note(p, older[p] if p in older else self._word(p))
        rest = [*others]
        for start in range(0, len(rest), 4096):
            some = rest[start:start + 4096]
            for p, ids in zip(some, self._whole(some), strict=True):
                note(p, ids)
        for split in marked:
            word, marks = split.groups()
            note(split[0], (once[word] if word in once else seen[word]) + (once[marks] if marks in once else seen[marks]))
        return once

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if len(self.seen) > self.remembered:
            self.older, self.seen = self.seen, Known({"": b""})
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        if not pc.sum(pc.binary_length(column)).as_py():
            return [b""] * len(column)
        pieces, first = self._pieces(column)
        kinds = pieces.dictionary_encode()
        names = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.drops_space:
            names = [p.strip(" \n") for p in names]
        seen = self.seen
        found = list(map(seen.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        once = self._remember([names[k] for k in missing])
        for k in missing:
            found[k] = once[names[k]] if names[k] in once else seen[names[k]]
        ids = pa.array(found, pa.large_binary()).take(kinds.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        row = memoryview(ids.buffers()[2] or b"")
        return [bytes(row[i:j]) for i, j in zip(bounds, bounds[1:])]


class Known(dict):
    """Ids by piece; a piece that is not known gives null and is noted."""

    def __missing__(self, piece: str) -> None:
        self.missing.append(piece)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, remembered: int | None = None) -> PieceEncoder:
    """One per file and worker process; it stays there for later tasks, so what it remembers counts in their memory too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, remembered)
    return _ENCODERS[path]


def release() -> None:
    """Let a worker process that goes on to other work forget its pieces."""
    _ENCODERS.clear()


def slices(lengths: list[int], most: int):
    """Index ranges whose lengths add up to about ``most``."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
