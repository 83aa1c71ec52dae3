"""Repair of conversations, against a search over all cheapest edits, turn by turn."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import types as T

from plumbline.llm import conversations
from plumbline.llm.common import Scratch

ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("part", "symbols", "position", "cost", "a.b")],
    ]
)
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "r", "s", "t") for r in rows], ROWS)


def plain(rows):
    """What ``repair`` must say of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANK)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    # Every state is (written roles' state) -> (cost, audit, written turns); insertions are relaxed until nothing changes.
    move = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    def relaxed(states):
        states = dict(states)
        while True:
            new = dict(states)
            for (p, letter), q in move.items():
                if p in states and letter != "s":
                    c, a, w = states[p]
                    new[q] = min(new.get(q, (10**9, "", ())), (c + 3, a + "I", (*w, (full[letter], ""))))
            if new == states:
                return states
            states = new

    states = {"0": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new, late = {}, 3 * (fault == "t")
        for p, (c, a, w) in relaxed(states).items():
            ways = [(p, 4, "D", ())]
            if fault not in ("b", "d"):
                if (p, role[:1]) in move:
                    ways.append((move[p, role[:1]], late, "K", ((role, text),)))
                ways += [(q, 3 + late, "R", ((full[x], text),)) for (s, x), q in move.items() if s == p and x != "s"]
            for q, cost, letter, added in ways:
                new[q] = min(new.get(q, (10**9, "", ())), (c + cost, a + letter, w + added))
        states = new
    cost, audit, written = min(v for k, v in relaxed(states).items() if k in ("0", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"),
        "truncated": faults.count("t"), "illegal": illegal, "cost": cost, "audit": audit,
    }, list(written)


def repaired(spark, rows, piece):
    scratch = Scratch(spark)
    found = conversations.repair(frame(spark, rows), scratch, piece)
    facts = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.conversations.collect()}
    texts = {i: [] for i in facts}
    for r in sorted(found.turns.collect(), key=lambda r: r["position"]):
        assert r["position"] == len(texts[r["conv_id"]])
        texts[r["conv_id"]].append((r["role"], r["text"]))
    digest = {r["conv_id"]: r["sha256"] for r in conversations.digests(found.turns).collect()}
    scratch.remove()
    assert digest == {i: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in x).encode()).hexdigest() for i, x in texts.items() if x}
    return facts, texts


def compared(spark, rows, piece):
    facts, texts = repaired(spark, rows, piece)
    assert set(facts) == {r[0] for r in rows}
    for i in facts:
        expected, written = plain([r[1:] for r in rows if r[0] == i])
        assert facts[i] == expected, (i, [r for r in rows if r[0] == i])
        assert texts[i] == written, i


def test_random_conversations_in_pieces_of_any_length(spark):
    pick = random.Random(4)
    rows = []
    for i in range(120):
        for turn in range(pick.choice([1, 2, 3, 5, 9, 14])):
            for _ in range(pick.choice([1, 1, 1, 2])):
                role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
                text = pick.choice(["Yes.", "No", "What?", "", None, " \n", "One. ", "Two\t", "Três!", f"Nr {turn}.", "x" * 3000 + "."])
                rows.append((i, pick.choice([turn, turn, turn, None, turn - 1]), role, text))
    compared(spark, rows, 3)
    compared(spark, rows, conversations.PIECE)


def test_rows_repeated_very_often_and_a_long_conversation(spark):
    rows = [(1, 5, "user", "Again.")] * 900 + [(None, None, None, None)] * 40 + [(None, 3, "system", "s."), (None, 4, "assistant", "a.")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"{k}." if k % 17 else "cut") for k in range(700) if k % 31]
    compared(spark, rows, 64)


def test_empty_table_and_conversations_with_nothing_left(spark):
    assert repaired(spark, [], 8) == ({}, {})
    facts, texts = repaired(spark, [(7, 0, "user", " "), (7, 1, "assistant", "")], 8)
    assert facts[7]["audit"] == "DD" and facts[7]["cost"] == 8 and texts[7] == []


def test_every_short_row_of_symbols():
    grammar = conversations.Grammar(((1, 2), (9, 9), (8, 8)))
    for n in range(5):
        for symbols in itertools.product((0, 1, 2, 3, 5, 8), repeat=n):
            at, of = np.array(symbols, np.int32), np.zeros(n, int)
            got = grammar.product(grammar.compressed(at, of)[0].astype(np.int32).tobytes())
            closed = conversations.times(got[:4], conversations.INSERTIONS)
            cost, rope = conversations.least(closed[0], closed[3])
            rows = [(k, ("system", "user", "assistant", "tool")[s % 4] if s != 8 else "user", "" if s == 8 else f"{k}." if s < 4 else f"{k}") for k, s in enumerate(symbols)]
            expected = plain(rows)[0]
            assert (cost, conversations.spelled(rope)) == (expected["cost"], expected["audit"]), symbols


def test_ropes_are_compared_as_they_are_spelled():
    pick = random.Random(1)

    def rope(text):
        if len(text) < 2 or pick.random() < 0.2:
            return text
        cut = pick.randint(1, len(text) - 1)
        return (rope(text[:cut]), rope(text[cut:]))

    for _ in range(2000):
        x, y = ("".join(pick.choice("DIK") for _ in range(pick.randint(0, 6))) for _ in range(2))
        assert conversations.before(rope(x), rope(y)) == (x < y)


def test_damage_follows_the_hash_of_id_and_turn(spark):
    import zlib

    rows = [(i, t, "assistant", "A. b!") for i in (1, 2, None) for t in (*range(40), None)]
    expected = []
    for i, t, role, text in rows:
        k = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        one = (i, t, "user" if k == 4 else role, "" if k == 1 else "A b" if k == 2 else text)
        expected += [one] * (0 if k == 0 else 2 if k == 3 else 1)
    found = [tuple(r) for r in conversations.damaged(frame(spark, rows)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
