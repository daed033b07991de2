"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions start only at its hits, checksums decide.

Three kinds of span are told by their form alone: ``assign`` (a value behind a word such as ``password``), ``access`` (an
access key id) and ``hex`` (a long hexadecimal run). Three more carry a checksum that has to hold: ``hosting`` and
``package`` tokens (CRC-32 in base 62 at their end) and ``wallet`` keys (Base58Check).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.store import texts

# Kinds in their order, keywords, patterns and least lengths.
KINDS = ("assign", "access", "hex", "hosting", "package", "wallet")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
    "hosting": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "package": ("npm_",), "wallet": ("xprv",),
}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HOSTING = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
PACKAGE = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
WALLET = re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![0-9A-Za-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hexadecimal digits as one letter, so that a long run of them is a keyword too.
HEX_CLASS = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
HEX_RUN = b"h" * HEX_LEAST


def crc_base62(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before, in base 62."""
    value, digits = zlib.crc32(token[:-6].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == token[-6:]


def base58_check(key: str) -> bool:
    """Whether the last four bytes are the start of the double SHA-256 of those before."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: By kind: the pattern to anchor at a hit, and whether its match is a span.
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST), "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "hosting": (HOSTING, lambda m: crc_base62(m[1])), "package": (PACKAGE, lambda m: crc_base62(m[1])),
    "wallet": (WALLET, lambda m: base58_check(m[1])),
}


class Scanner:
    def __init__(self):
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.keywords.add_word(word, (kind, len(word)))
        self.keywords.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` by start and kind, in code points; each kind's matches are leftmost and do not overlap."""
        flat = text.encode("latin-1", "replace")  # one byte for each code point, so places are those of the text
        found = []
        behind = dict.fromkeys(CHECKS, 0)
        for last, (kind, size) in self.keywords.iter(flat.translate(LOWER).decode("latin-1")):
            start = last - size + 1
            if start < behind[kind]:
                continue
            pattern, holds = CHECKS[kind]
            match = pattern.match(text, start)
            if match:
                behind[kind] = match.end()
                if holds(match):
                    found.append((start, match.end(), kind))
        runs = flat.translate(HEX_CLASS)
        start = runs.find(HEX_RUN)
        while start >= 0:
            end = HEX.match(text, start).end()
            found.append((start, end, "hex"))
            start = runs.find(HEX_RUN, end)
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return found


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: an array of ``kind, start, end`` (code points, end exclusive) by start and kind for every row.

    A span that fails its length or checksum is left out, but matches of its kind go on behind it. A null or empty text has no
    spans. Rows are independent, so repeated rows and null ids keep their own result; other columns are not read; an
    empty table gives no rows. The work grows with a text's length, whatever its hits.
    """
    source = texts(df, id_col, text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner()
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind string, start long, end long>>")
