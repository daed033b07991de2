"""Repair of a conversation's role order by iterative-deepening A* over edits.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Each row is kept, given another role or deleted, and
empty rows may be inserted; the cheapest edits win, and of those the ones whose initials are least in ASCII order. The
search goes depth first in that order (Delete, Insert, Keep, Rerole) under a bound that grows to the least cost that went over it;
a table of failed states keeps it from searching a state twice with no more left to spend, so the first path that is
accepted is the answer.

A conversation of ordinary size is repaired by the task that holds it. The rows of a larger one are sorted over all tasks and
cut into pieces: what each piece costs between any two states of the automaton says what is left to pay behind the others,
and with that each piece is searched on its own. Only 16 numbers for a piece, and then the texts for the hash over the whole
conversation, pass through one task in their order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import keep, same, worker_path

# Costs of edits, white space, and marks that end a sentence.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDS = ".!?"
SPACE = " \t\n\x0b\x0c\r"
DAMAGE_OF = 20

#: States of the automaton: nothing yet, after s, after u, after a; and the role that may come next, by initial.
STATES = 4
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: In a given state only one of user and assistant fits, so an edit's initial says which.
FITS = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: What the insertions cost that complete a conversation from a state.
CLOSING = (0, 2 * INSERT, INSERT, 0)
CLOSERS = ("", "II", "I", "")
FAR = 1 << 40

#: A row as one letter: ``d`` has to go; else the role's initial, upper case if truncated; ``x`` and ``X`` for another initial.
LEGAL = frozenset("sua")
PAIRS = frozenset({"su", "ua", "au"})

#: Rows that are searched at once; longer conversations are cut, and the cuts' states chosen by what each cut costs.
CHUNK = 24
#: Conversations with more rows or characters are dealt over tasks in pieces.
MOST_ROWS, MOST_CHARS, PIECE = 4_096, 16_000_000, 480


def _row_costs(sign: str) -> tuple[int, int, int]:
    """What deleting, keeping and giving another role to a row cost."""
    if sign == "d":
        return DELETE, FAR, FAR
    late = TRUNCATED if sign.isupper() else 0
    return DELETE, (FAR if sign in "xX" else KEEP + late), REROLE + late


class _Rows:
    """Costs of a few rows, and for each place a bound from below of what the rows from there on cost.

    A row costs its cheapest edit. Two rows left as they are, but in an order that is not allowed, need another edit of
    either, or an insertion. An edit touches two neighbours, so each is charged half of what it costs beyond the cheapest;
    all sums are kept twice as large.
    """

    def __init__(self, signs: str):
        self.n = n = len(signs)
        self.costs = [_row_costs(s) for s in signs]
        self.low = signs.lower()
        self.rest, self.next, self.spare = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            delete, kept, rerole = self.costs[i]
            least = min(delete, kept, rerole)
            self.rest[i], self.next[i], self.spare[i] = self.rest[i + 1] + 2 * least, self.next[i + 1], self.spare[i + 1]
            if signs[i] == "d":
                continue
            letter, spare = self.low[i], min(delete, rerole) - kept if kept == least else 0
            after = self.next[i + 1]
            if after in LEGAL and letter in LEGAL and letter + after not in PAIRS:
                self.rest[i] += min(spare, self.spare[i + 1], 2 * INSERT)
            self.next[i], self.spare[i] = letter, spare

    def bound(self, place: int, state: int) -> int:
        owed = self.rest[place]
        if self.next[place] in LEGAL and self.next[place] not in NEXT[state]:
            owed += min(self.spare[place], 2 * INSERT)
        return owed


def search(rows: _Rows, start: int, owed: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Cost, edits and last state of the cheapest path over all rows from state ``start``; null if there is none.

    ``owed`` is what is left to pay from each last state: it counts in the cost. Insertions stand before a row. Of the
    cheapest paths, the one whose edits are least in ASCII order is found.
    """
    n, costs, low = rows.n, rows.costs, rows.low
    least_owed = 2 * min(owed)
    if least_owed >= 2 * FAR:
        return None
    early = min(owed[2:]) >= FAR  # then all rows go, but for one s
    path: list[str] = []

    def estimate(place: int, state: int) -> int:
        if not early:
            return rows.bound(place, state)
        if state > 1 or state == 1 and owed[1] >= FAR:
            return 2 * FAR
        return 2 * DELETE * max(0, n - place - (state == 0 and owed[1] < FAR))

    failed: dict[tuple[int, int], int] = {}  # most that was left to spend where a search failed
    over, last = FAR, start

    def visit(place: int, state: int, left: int, inserted: int) -> bool:
        nonlocal over, last
        short = (owed[state] if place == n else (estimate(place, state) + least_owed + 1) // 2) - left
        if short > 0:
            over = min(over, short)
            return False
        if place == n:
            last = state
            return True
        if failed.get((place, state), -1) >= left:
            return False
        delete, kept, rerole = costs[place]
        fits = 3 if FITS[state] == "a" else 2
        path.append("D")
        if visit(place + 1, state, left - delete, 0):
            return True
        if kept < FAR or rerole < FAR:  # before a row that has to go, an insertion can as well come after it, which is less
            if inserted < 2:  # a third insertion comes back to a state of this place
                path[-1] = "I"
                if visit(place, fits, left - INSERT, inserted + 1):
                    return True
            if kept < FAR and low[place] in NEXT[state]:
                path[-1] = "K"
                if visit(place + 1, NEXT[state][low[place]], left - kept, 0):
                    return True
            path[-1] = "R"
            if visit(place + 1, fits, left - rerole, 0):
                return True
        path.pop()
        failed[place, state] = left
        return False

    bound = (estimate(0, start) + least_owed + 1) // 2 if n else min(owed)
    while bound < FAR:
        over = FAR
        failed.clear()
        if visit(0, start, bound, 0):
            return bound, "".join(path), last
        bound += over
    return None


def _cuts(signs: str) -> list[_Rows]:
    return [_Rows(signs[i:i + CHUNK]) for i in range(0, len(signs), CHUNK)]


def _between(rows: _Rows) -> list[list[int]]:
    """What the rows cost from each state to each."""
    ends = [tuple(0 if t == end else FAR for t in range(STATES)) for end in range(STATES)]
    found = [[search(rows, s, e) for e in ends] for s in range(STATES)]
    return [[f[0] if f else FAR for f in line] for line in found]


def _before(costs: list[list[int]], owed: tuple[int, ...]) -> tuple[int, ...]:
    """What is left to pay before rows with these costs, from what is left behind them."""
    return tuple(min(FAR, *(c + o for c, o in zip(line, owed, strict=True))) for line in costs)


def _joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [list(_before(list(zip(*b, strict=True)), tuple(line))) for line in a]


def _walk(cuts: list[_Rows], costs: list[list[list[int]]], start: int, owed: tuple[int, ...]) -> tuple[str, int] | None:
    """Edits and last state over all cuts, from a state."""
    behind = [owed][:len(cuts)]
    for c in costs[:0:-1]:
        behind.append(_before(c, behind[-1]))
    path, state = [], start
    for rows, left in zip(cuts, behind[::-1], strict=True):
        found = search(rows, state, left)
        if found is None:
            return None
        path.append(found[1])
        state = found[2]
    return "".join(path), state


def repair(signs: str) -> tuple[int, str]:
    """Cost and edits for a whole conversation."""
    cuts = _cuts(signs)
    costs = [_between(c) for c in cuts] if len(cuts) > 1 else [[]] * len(cuts)
    path, state = _walk(cuts, costs, 0, CLOSING)
    audit = path + CLOSERS[state]
    return sum(_paid(signs, audit)), audit


def _paid(signs: str, audit: str) -> Iterator[int]:
    rows = iter(signs)
    for edit in audit:
        yield INSERT if edit == "I" else _row_costs(next(rows))["DKR".index(edit)]


def replay(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """Role and text of the repaired rows, and the last state."""
    out, i = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[i]
        i += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[0]]
        else:
            role = ROLE[FITS[state]]
            state = 3 if FITS[state] == "a" else 2
        out.append((role, text))
    return out, state


def _sign(role: str, text: str, repeated: bool) -> str:
    solid = text.strip(SPACE)
    if not solid or repeated:
        return "d"
    letter = role[0] if role[:1] in LEGAL else "x"
    return letter if solid[-1] in ENDS else letter.upper()


class _Tally:
    """Faults of rows in their order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, role: str, text: str, sign: str) -> None:
        if sign == "d":
            if text.strip(SPACE):
                self.duplicate += 1
            else:
                self.blank += 1
        elif sign.isupper():
            self.truncated += 1
        self.border(role[:1])

    def border(self, letter: str | None, last: str | None = None) -> None:
        if self.last is None:
            self.first = letter
        elif self.last + letter not in PAIRS:
            self.illegal += 1
        self.last = letter if last is None else last


def damaged(df: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """``conv_id, turn, role, text, times`` with a fixed share of the rows damaged; ``times`` is 0 for a dropped row, 2 for a repeated one.

    The CRC-32 of ``<conv_id>:<turn>`` modulo 20 picks the damage: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 sets its role to user. Nulls read as one space, but a null turn or id stays null as a column.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in columns)

    def plain(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % DAMAGE_OF
    return df.select(conv.alias("conv_id"), turn.alias("turn"), plain(role).alias("role"), plain(text).alias("text"), hit.alias("hit")).select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("times"))



#: Order of a conversation's rows; ``tie`` is a hash of the text.
ORDER = ("conv_id", "turn", "role", "tie", "text")

FAULTS = ("blank", "duplicate", "truncated", "illegal", "cost")
ROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _records(done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.bool_(), *[pa.int64()] * len(FAULTS), pa.string(), pa.string(), ROW]
    columns = zip(*done, strict=True) if done else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                      ["conv_id", "piece", "last", *FAULTS, "audit", "repaired_sha256", "repaired"])


def _schema(kind: str) -> str:
    faults = ", ".join(f"{f} long" for f in FAULTS)
    return f"conv_id {kind}, piece long, last boolean, {faults}, audit string, repaired_sha256 string, repaired array<struct<role string, text string>>"


def _repair_whole(rows: DataFrame, id_type: pa.DataType, kind: str) -> DataFrame:
    """Conversations that one task can hold, one after the other."""
    def finish(conv, found: list[tuple[str, str]]) -> tuple:
        tally, seen, signs = _Tally(), set(), []
        for row in found:
            sign = _sign(*row, row in seen)
            seen.add(row)
            tally.add(*row, sign)
            signs.append(sign)
        cost, audit = repair("".join(signs))
        lines, _ = replay(audit, 0, found)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        return (conv, 0, True, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit,
                hashlib.sha256(text.encode()).hexdigest(), [{"role": r, "text": t} for r, t in lines])

    def run(batches: Iterator[pa.RecordBatch]):
        begun, conv, found = False, None, []
        for batch in batches:
            done = []
            for at, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and at != conv:
                    done.append(finish(conv, found))
                    found = []
                begun, conv = True, at
                found += [(role, text)] * times
            yield _records(done, id_type)
        yield _records([finish(conv, found)] if begun else [], id_type)

    dealt = rows.repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "role", "text", "times").mapInArrow(run, _schema(kind))


def _cut(rows: DataFrame, id_type: pa.DataType, kind: str, piece_rows: int) -> DataFrame:
    """Rows of large conversations in their order, in pieces: ``conv_id, part, piece`` in ascending order are a conversation."""
    one = rows.where("times > 0").groupBy(*ORDER).agg(F.sum("times").alias("times")).withColumn("digest", F.md5("text"))
    # Nulls come first in a least struct too, so a text's first turn is right with null turns.
    first = one.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first")) \
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    marked = one.join(first, same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("long")))) \
        .withColumn("repeated", ~F.col("turn").eqNullSafe(F.col("first")) | (F.col("copy") > 1))
    names = ["part", "piece", "signs", "costs", "whole", "first", "end", "blank", "duplicate", "truncated", "illegal", "roles", "texts"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string(),
             *[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]):
        part, piece = TaskContext.get().partitionId(), 0
        conv, begun, found, chars = None, False, [], 0

        def finish() -> pa.RecordBatch:
            tally, signs = _Tally(), []
            for role, text, repeated in found:
                signs.append(_sign(role, text, repeated))
                tally.add(role, text, signs[-1])
            costs = [_between(c) for c in _cuts("".join(signs))]
            flat = [v for c in costs for line in c for v in line]
            whole = [v for line in reduce(_joined, costs) for v in line]
            row = [part, piece, "".join(signs), flat, whole, tally.first, tally.last, tally.blank, tally.duplicate, tally.truncated, tally.illegal,
                   [f[0] for f in found], [f[1] for f in found]]
            return pa.RecordBatch.from_arrays([pa.array([conv], id_type), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], ["conv_id", *names])

        for batch in batches:
            for at, role, text, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and (at != conv or len(found) >= piece_rows or chars >= MOST_CHARS):
                    yield finish()
                    piece, found, chars = piece + 1, [], 0
                begun, conv = True, at
                found.append((role, text, repeated))
                chars += len(text)
        if begun:
            yield finish()

    placed = marked.repartitionByRange("conv_id", "turn", "role", "tie", "copy").sortWithinPartitions(*ORDER, "copy")
    return placed.select("conv_id", "role", "text", "repeated").mapInArrow(
        run, f"conv_id {kind}, part int, piece long, signs string, costs array<long>, whole array<long>, first string, end string, "
             "blank long, duplicate long, truncated long, illegal long, roles array<string>, texts array<string>")


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[i:i + STATES] for i in range(0, STATES * STATES, STATES)]


def _owed(pieces: DataFrame, id_type: pa.DataType, kind: str) -> DataFrame:
    """What is left to pay behind each piece, from each state. A conversation's costs, 16 numbers for a piece, pass through one task."""
    def run(batches: Iterator[pa.RecordBatch]):
        conv, begun, places, costs = None, False, [], []

        def finish() -> pa.RecordBatch:
            owed = [CLOSING]
            for c in costs[:0:-1]:
                owed.append(_before(_square(c.tolist()), owed[-1]))
            rows = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(places), id_type), *(pa.array(list(c), k) for c, k in zip(rows, (pa.int32(), pa.int64()), strict=True)),
                 pa.array([list(o) for o in reversed(owed)], pa.list_(pa.int64()))], ["in_conv", "in_part", "in_piece", "owed"])

        for batch in batches:
            for at, part, piece, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and at != conv:
                    yield finish()
                    places, costs = [], []
                begun, conv = True, at
                places.append((part, piece))
                costs.append(array("q", whole))
        if begun:
            yield finish()

    small = pieces.select("conv_id", "part", "piece", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return small.mapInArrow(run, f"in_conv {kind}, in_part int, in_piece long, owed array<long>")


def _walked(pieces: DataFrame) -> DataFrame:
    """Each piece's edits and last state from every state."""
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            audits, ends = [], []
            for signs, costs, owed in zip(*(batch.column(names.index(c)).to_pylist() for c in ("signs", "costs", "owed")), strict=True):
                cuts = _cuts(signs)
                between = [_square(costs[i:]) for i in range(0, len(costs), STATES * STATES)]
                found = [_walk(cuts, between, s, tuple(owed)) or (None, None) for s in range(STATES)]
                audits.append([f[0] for f in found])
                ends.append([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                                             [*names, "audits", "ends"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{fields}, audits array<string>, ends array<int>")


def _assembled(pieces: DataFrame, id_type: pa.DataType, kind: str) -> DataFrame:
    """One row for each piece, with what its conversation comes to on the last. A hash runs over a text in its order, so a
    conversation's pieces pass through one task, one at a time."""
    names = ["conv_id", "signs", "first", "end", "blank", "duplicate", "truncated", "illegal", "roles", "texts", "audits", "ends"]

    def run(batches: Iterator[pa.RecordBatch]):
        held, conv, state, number, digest, parts, tally, cost = None, None, 0, 0, None, [], None, 0

        def ended(lines) -> pa.RecordBatch:
            more, _ = replay(CLOSERS[state], state, [])
            hashed(more)
            closed = cost + CLOSING[state]
            row = (conv, number, True, tally.blank, tally.duplicate, tally.truncated, tally.illegal, closed, "".join(parts) + CLOSERS[state],
                   digest.hexdigest(), [{"role": r, "text": t} for r, t in lines + more])
            return _records([row], id_type)

        def hashed(lines) -> None:
            nonlocal some
            for role, text in lines:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        some = False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, signs, first, end, blank, duplicate, truncated, illegal, roles, texts, audits, ends = row
                if held is not None:
                    if at == conv:
                        yield _records([(conv, number, False, *[None] * len(FAULTS), None, None, [{"role": r, "text": t} for r, t in held])], id_type)
                        number += 1
                    else:
                        yield ended(held)
                if held is None or at != conv:
                    conv, state, number, digest, parts, tally, cost, some = at, 0, 0, hashlib.sha256(), [], _Tally(), 0, False
                audit = audits[state]
                held, _ = replay(audit, state, list(zip(roles, texts, strict=True)))
                state = ends[state]
                hashed(held)
                parts.append(audit)
                cost += sum(_paid(signs, audit))
                tally.border(first, end)
                tally.blank, tally.duplicate = tally.blank + blank, tally.duplicate + duplicate
                tally.truncated, tally.illegal = tally.truncated + truncated, tally.illegal + illegal
        if held is not None:
            yield ended(held)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(*names).mapInArrow(run, _schema(kind))


def repair_conversations(rows: DataFrame, most_rows: int = MOST_ROWS, piece_rows: int = PIECE) -> DataFrame:
    """Repaired conversations of ``rows(conv_id, turn, role, text, times)``, a row counting ``times`` times.

    Gives ``conv_id, piece, last, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` and ``repaired``, the repaired
    rows. A conversation of ordinary size is one row; a larger one has its repaired rows in several, by ``piece``, and all
    other columns on the last. Rows go by turn, null turns first; those of one turn by role and then by a hash of the text, so
    repeated rows stand together. A row that is blank (white space only), repeats an earlier role and text, or ends without a
    mark has that as its one fault. Conversations without rows have zeros and an empty audit; a null id is a conversation of its
    own; an empty table gives no rows. Other columns are not read. Both limits say how the work is dealt and change no result.
    """
    spark = rows.sparkSession
    worker_path(spark)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "times") \
        .withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # The rows of large conversations are few distinct ids: no more than all rows by the limit.
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    large = keep(size.where((F.col("n") > most_rows) | (F.col("chars") > MOST_CHARS)).select(F.col("conv_id").alias("large")), "large_conversations")
    on = same(F.col("conv_id"), F.col("large"))
    if large.isEmpty():
        found = _repair_whole(rows, id_type, kind)
    else:
        pieces = keep(_cut(rows.join(large, on, "left_semi"), id_type, kind, piece_rows), "conversation_pieces")
        owed = keep(_owed(pieces, id_type, kind), "conversation_owed")
        place = same(F.col("conv_id"), F.col("in_conv")) & (F.col("part") == F.col("in_part")) & (F.col("piece") == F.col("in_piece"))
        walked = _walked(pieces.join(owed, place).drop("in_conv", "in_part", "in_piece", "whole"))
        none = large.select(F.col("large").alias("conv_id"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("times"),
                            F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(0).cast("long").alias("tie")) \
            .join(pieces.select(F.col("conv_id").alias("large")).distinct(), on, "left_anti")  # all rows dropped
        found = _repair_whole(rows.join(large, on, "left_anti").unionByName(none), id_type, kind).unionByName(_assembled(walked, id_type, kind))
    turns = rows.where("times > 0 and turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("in_conv")) \
        .agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    return found.join(turns, same(F.col("conv_id"), F.col("in_conv")), "left") \
        .select("conv_id", "piece", "last", F.when(F.col("last"), F.coalesce("gaps", F.lit(0).cast("long"))).alias("gaps"), *FAULTS, "audit", "repaired_sha256", "repaired")
