"""Conversation repair against brute force, on small and on divided conversations, and on odd rows."""

import hashlib
import random
import zlib

import pytest

from postlens.llm import repair

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least (cost, edits) over all rows by states, from the front; rows are (initial, has to go, truncated)."""
    def inserted(best):
        for _ in range(3):
            for state, (cost, edits) in list(best.items()):
                for letter in "ua":
                    to = STEP.get((state, letter))
                    if to:
                        best[to] = min(best.get(to, (10**9, "")), (cost + 3, edits + "I"))
        return best

    best = {"": (0, "")}
    for letter, go, late in rows:
        new = {}
        for state, (cost, edits) in inserted(best).items():
            options = [(state, 4, "D")]
            if not go:
                options += [(STEP.get((state, letter)), 3 * late, "K")]
                options += [(STEP.get((state, x)), 3 + 3 * late, "R") for x in "ua"]
            for to, price, edit in options:
                if to is not None:
                    new[to] = min(new.get(to, (10**9, "")), (cost + price, edits + edit))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    """All columns of one conversation's rows (turn, role, text) in their order."""
    seen, judged, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(judged)
    out, i, state = [], 0, ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[i][1:]
        i += edit != "I"
        if edit == "D":
            continue
        letter = role[0] if edit == "K" else next(x for x in "ua" if (state, x) in STEP)
        out.append(f"{role if edit == 'K' else ROLES[letter]}:{text}")
        state = STEP[state, letter]
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **count, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damage(table):
    """Rows by conversation after the damage, by turn."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            rows += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
    return groups


def signs(rows):
    return "".join("d" if go else (x.upper() if late else x) for x, go, late in rows)


def test_search():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 12) if rng.random() < 0.9 else rng.randint(20, 130)
        rows = []
        for i in range(n):
            x = rng.choice("suax") if rng.random() < 0.3 else "ua"[i % 2]
            rows.append((x, rng.random() < 0.1, rng.random() < 0.2))
        assert repair.repair(signs(rows)) == cheapest(rows), rows


def test_cuts_do_not_show(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(repair, "CHUNK", 3)
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 20))]
        assert repair.repair(signs(rows)) == cheapest(rows), rows


def table(rng, many):
    rows = []
    for conv in [None, *range(many)]:
        for turn in range(rng.choice([1, 2, 3, 8, 15, 40])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.2 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "why", " \n", "", None, "Ünï?", f"w{rng.random()}."])
            rows.append((conv, None if rng.random() < 0.02 else turn * 2 if rng.random() < 0.05 else turn, role, text))
    firsts = {}
    for r in rows:  # one row for a turn: rows of one turn have no stated order between them
        firsts.setdefault(r[:2], r)
    return list(firsts.values())


@pytest.mark.parametrize("limits", [{}, {"most_rows": 2, "piece_rows": 3}, {"most_rows": 0, "piece_rows": 30}])
def test_conversations(spark, limits):
    rows = table(random.Random(3), 80)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int").repartition(5)
    got = repair.repair_conversations(repair.damaged(frame), **limits).collect()
    want = {c: brute(r) for c, r in damage(rows).items()}
    last = {r.conv_id: {k: r[k] for k in want[None]} for r in got if r["last"]}
    assert last == want and sum(r["last"] for r in got) == len(want)
    texts = {}
    for r in sorted(got, key=lambda r: r.piece):
        texts.setdefault(r.conv_id, []).extend(f"{x.role}:{x.text}" for x in r.repaired)
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: w["repaired_sha256"] for c, w in want.items()}
    assert (len(got) > len(want)) == bool(limits)


def test_repeated_rows_stand_together(spark):
    rows = [(1, None, "user", "Hi.")] * 50 + [(1, 3, "assistant", "Yes.")] * 2 + [(2, 1, "user", "x" * 2_000_000 + ".")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, times int")
    want = {1: brute([r[1:] for r in rows if r[0] == 1]), 2: brute([rows[-1][1:]])}
    for limits in ({}, {"most_rows": 1, "piece_rows": 7}):
        got = {r.conv_id: {k: r[k] for k in want[1]} for r in repair.repair_conversations(frame, **limits).where("last").collect()}
        assert got == want and want[1]["duplicate"] == 50


def test_dropped_and_empty(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi.", 0), (2, 1, None, None, 1)], "conv_id long, turn long, role string, text string, times int")
    for limits in ({}, {"most_rows": 0}):
        got = {r.conv_id: r for r in repair.repair_conversations(frame, **limits).collect()}
        assert (got[1].cost, got[1].audit, got[1].gaps, got[1].repaired) == (0, "", 0, [])
        assert got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest()
        assert (got[2].blank, got[2].audit, got[2].cost) == (1, "D", 4)
    assert repair.repair_conversations(frame.limit(0)).collect() == []
