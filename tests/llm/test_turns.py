"""Conversation repair against an exhaustive search and against a plain row-by-row program."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import pytest

from foldloom.llm import turn_repair as t

ROWS = "conv_id long, turn long, role string, text string, conv string, at int, part string, symbol int"
EXTRA = ("c", 1, "p", 2)


def legal(initials: str) -> bool:
    rest = initials.removeprefix("s")
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def plain(rows: list[tuple]) -> tuple:
    """Result of rows (turn, role, text) in order, from costs of whole suffixes kept as (cost, edits, lines)."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = text.strip(t.SPACE)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def grow(after: str, role: str) -> str | None:
        """State after a role: nothing yet, s, u or a."""
        goal = role[:1]
        return goal if (after, goal) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    far = (1 << 60, "", ())
    best = {"": (0, "", ()), "a": (0, "", ()), "s": far, "u": far}

    def insert(costs):
        out = dict(costs)
        for _ in range(3):
            for q in costs:
                for role in ("user", "assistant"):
                    to = grow(q, role)
                    if to:
                        c, e, lines = out[to]
                        out[q] = min(out[q], (c + 5, "I" + e, (f"{role}:", *lines)))
        return out

    best = insert(best)
    for (_, role, text), fault in zip(rows[::-1], faults[::-1], strict=True):
        now = {}
        for q in best:
            c, e, lines = best[q]
            ways = [(c + 2, "D" + e, lines)]
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                for new, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    to = grow(q, new)
                    if to:
                        c, e, lines = best[to]
                        ways.append((c + cost + late, letter + e, (f"{new}:{text}", *lines)))
            now[q] = min(ways)
        best = insert(now)
    cost, audit, lines = best[""]
    turns = {k for k, _, _ in rows if k is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_grammar_by_exhaustive_search():
    """All edits of short conversations, with up to three inserts anywhere."""
    for n in range(4):
        for roles in product("sua", repeat=n):
            best = None
            for edits in product("DKR", repeat=n):
                cost = sum(t.COSTS[e] for e in edits)
                for spots in product(range(4), repeat=n + 1):
                    if sum(spots) > 3:
                        continue
                    audit = "".join("I" * s + e for s, e in zip(spots, [*edits, ""], strict=True))
                    # inserts and rerolled rows may be u or a: the grammar decides, so either may stand
                    def fits(prefix, rest, rows, roles=roles):
                        if not rest:
                            return legal(prefix)
                        head, rows_left = rest[0], rows + (rest[0] != "I")
                        if head == "D":
                            return fits(prefix, rest[1:], rows_left)
                        marks = roles[rows] if head == "K" else "ua"
                        return any(fits(prefix + m, rest[1:], rows_left) for m in marks)
                    if fits("", audit, 0):
                        found = (cost + 5 * sum(spots), audit)
                        best = min(best or found, found)
            names = {"s": "system", "u": "user", "a": "assistant"}
            out = t.repair_rows([(k, names[r], f"row {k}.") for k, r in enumerate(roles)])
            assert (out[5], out[6]) == best


def random_rows(rnd: random.Random, n: int) -> list[tuple]:
    texts = ["ok.", "fine!", "cut", "", " \t", "so?", "odd"]
    return [(k if rnd.random() < .9 else None, rnd.choice(["user", "assistant", "system", "tool", "", "Ux"]),
             rnd.choice(texts) if rnd.random() < .4 else f"t{k}.") for k in range(n)]


def test_rows_against_the_plain_program():
    rnd = random.Random(3)
    for _ in range(400):
        rows = random_rows(rnd, rnd.randint(0, 14))
        assert t.repair_rows(rows) == plain(rows)
    for role in ("user", "assistant", "system", "tool"):
        rows = [(k, role, f"same {k}." if k % 400 else "cut") for k in range(3001)]
        assert t.repair_rows(rows) == plain(rows)


@pytest.mark.parametrize("buffered", [20_000, 2])
def test_conversations_in_ranges_and_pieces(spark, monkeypatch, buffered):
    """Short and very long conversations, odd ids and rows; a small buffer sends all of them through the pieces."""
    monkeypatch.setattr(t, "BLOCK_CHARS", 200)
    rnd = random.Random(8)
    conversations = {c: random_rows(rnd, rnd.randint(1, 9)) for c in range(40)}
    conversations |= {None: random_rows(rnd, 5), 50: random_rows(rnd, 900), (1 << 60) + 1: random_rows(rnd, 6), 51: [(1, "user", "w " * 300_000 + ".")], 52: [(None, "user", "a.")] * 9}
    rows = [(c, *r, *EXTRA) for c, found in conversations.items() for r in found]
    rows += [(60, 1, None, None, *EXTRA), (61, None, "user", None, *EXTRA)]
    rnd.shuffle(rows)
    if buffered == 2:
        before = t.walk_range
        monkeypatch.setattr(t, "walk_range", lambda it, schema: (setattr(t, "BUFFER_ROWS", 2), before(it, schema))[1])
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    out = t.repair(frame).collect()
    expected = {}
    for c, turn, role, text, *_ in rows:
        expected.setdefault(c, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    assert len(out) == len(expected) and out[0].__fields__ == ["conv_id", *t.RESULTS, "audit", "repaired_sha256"]
    for r in out:
        ordered = sorted(expected[r.conv_id], key=lambda x: (
            x[0] is not None, x[0] or 0, x[1][:32].encode(), x[2][:64].encode(), hashlib.md5(f"{x[1]}\0{x[2]}".encode()).hexdigest()))
        assert tuple(r)[1:] == plain(ordered), r.conv_id


def test_absent_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a.", *EXTRA), (1, 2, "assistant", "b.", *EXTRA), (2, 1, "user", "a.", *EXTRA)], ROWS)
    out = {r.conv_id: tuple(r)[1:] for r in t.repair(frame, absent=frame.conv_id == 2).collect()}
    assert out == {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()), 2: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert t.repair(spark.createDataFrame([], ROWS)).collect() == []
