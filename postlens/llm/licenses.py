"""Licence scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.store import texts

# The base phrases, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, in lower-case words.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "boost",
    "creative commons": "cc", "under cc by": "cc", "cc by sa": "cc", "cc by nc": "cc", "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
# Prefix of an identifier -> label and how much the licence asks for (0 nothing, 1 notice, 2 same files, 3 whole work).
IDENTIFIERS = (
    ("lgpl", "lgpl", 2), ("agpl", "agpl", 3), ("gpl", "gpl", 3), ("apache", "apache", 1), ("mit", "mit", 1), ("bsd", "bsd", 1),
    ("mpl", "mpl", 2), ("epl", "epl", 2), ("isc", "isc", 1), ("bsl", "boost", 1), ("cc0", "public-domain", 0),
    ("unlicense", "public-domain", 0), ("cc-", "cc", 1),
)
TAG = "spdx-license-identifier:"
TOKEN = re.compile(r"[ \t]*([A-Za-z0-9.+:_-]+|[()])")
MARKS = ".+:_-"
LINE_END = re.compile(r"[ \t\r]*(?:\n|\Z)")
BINDS = {"or": 1, "and": 2, "with": 3}
SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def parse_expression(text: str) -> list[str] | None:
    """A whole licence expression in postfix order; null if it is malformed."""
    found = expression_at(text, 0)
    return found[0] if found and not text[found[1]:].strip() else None


def expression_at(text: str, start: int) -> tuple[list[str], int] | None:
    """The longest well-formed licence expression that begins at ``start``, in postfix order, and where it ends; null without one.

    ``with`` binds before ``and``, ``and`` before ``or``. Tokens stand behind each other with nothing but spaces and tabs
    between them; the first that cannot go on ends the expression. A line that breaks off behind ``and``, ``or``, ``with`` or
    a bracket says nothing.
    """
    out, waiting, operand, depth = [], [], False, 0
    best, end = None, start
    while True:
        token = TOKEN.match(text, end)
        if not token:
            if not operand and waiting and LINE_END.match(text, end):
                return None
            break
        word, low = token[1], token[1].lower()
        if low in BINDS:
            if not operand:
                break
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif word == "(":
            if operand:
                break
            waiting.append(word)
            depth += 1
        elif word == ")":
            if not operand or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif operand or not word.strip(MARKS):
            break
        else:
            out.append(word)
            operand = True
        end = token.end()
        if operand and not depth:
            best = len(out), waiting[::-1], end
    return best and (out[:best[0]] + best[1], best[2])


def evaluate(postfix: list[str]) -> tuple[set[str], int | None]:
    """Labels named, and what the reader has to accept: the least of ``or``'s sides, the most of ``and``'s; an exception asks one less."""
    stack: list[tuple[set[str], int | None]] = []
    for token in postfix:
        if token in BINDS:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((a, None if x is None else max(0, x - 1)))
            else:
                known = [v for v in (x, y) if v is not None]
                stack.append((a | b, (min if token == "or" else max)(known) if known else None))
        else:
            found = next(((label, ask) for prefix, label, ask in IDENTIFIERS if token.lower().startswith(prefix)), None)
            stack.append(({found[0]}, found[1]) if found else (set(), None))
    return stack[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.notices, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (NOTICES | BASE).items():
            self.notices.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        self.tags.add_word(TAG, len(TAG))
        self.notices.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str) -> tuple:
        raw = text.encode()
        words = raw.translate(SEPARATORS).split()
        hay = f" {b' '.join(words).decode()} "
        base, labels, starts, hits, expressions, ask = set(), set(), [], 0, [], None
        seen, upto = 0, 0  # words that begin before a place in ``hay``; hits come by their ends, so a start may lie a phrase back
        for end, (size, label, is_base) in self.notices.iter(hay):
            labels.add(label)
            hits += 1
            if is_base:
                base.add(label)
                at = end - size + 1
                seen += hay.count(" ", upto, at) if at >= upto else -hay.count(" ", at, upto)
                upto = at
                starts.append(seen)
        low = raw.lower().decode()  # of A-Z only, so places are those of the text
        if "spdx" in low:
            for end, _ in self.tags.iter(low):
                parsed = expression_at(text, end + 1)
                if parsed:
                    named, need = evaluate(parsed[0])
                    labels |= named
                    expressions.append(" ".join(TOKEN.findall(text, end + 1, parsed[1])))
                    ask = need if ask is None else ask if need is None else max(ask, need)
        score = 1 - 0.5 ** (len(starts) * 2 + (hits - len(starts)) + 3 * len(expressions))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score, expressions, ask)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices, identifier tags and their expressions in each text.

    Words are runs of digits, letters and code points from 128 on, A-Z lower-cased. ``n_base``, ``first_word`` and
    ``last_word`` count the base phrases' places; ``labels`` also has those of further notices and of identifier tags.
    ``expressions`` lists well-formed tag expressions, ``asks`` the most that one of them asks for. ``score`` is 0 without
    evidence and nears 1 with more of it. A null or empty text has no words and no labels. Rows are independent, so repeated
    rows and null ids keep their own result.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.int32()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "asks"]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", *names])

    source = texts(df, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
                                  "last_word long, base_labels string, labels string, score double, expressions array<string>, asks int")
