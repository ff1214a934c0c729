from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tarn.llm import dialogue

FIELDS = "conv_id long, turn long, role string, text string"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, letters) of the best edits by looking back from the end; rows are (initial, fault)."""

    @lru_cache(maxsize=None)
    def best(i, state, put):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        steps = []
        if put < 2:
            steps += [(2, "I", i, FOLLOWS[state, r], put + 1) for r in "ua" if (state, r) in FOLLOWS]
        if i < len(rows):
            initial, fault = rows[i]
            more = int(fault == "truncated")
            steps.append((3, "D", i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                steps += [(more, "K", i + 1, FOLLOWS[state, initial], 0)] if (state, initial) in FOLLOWS else []
                steps += [(2 + more, "R", i + 1, FOLLOWS[state, r], 0) for r in "ua" if (state, r) in FOLLOWS]
        for cost, letter, at, after, inserted in steps:
            if rest := best(at, after, inserted):
                found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    return best(0, "", 0)


def expected(rows):
    """The result row of one conversation, by the rule, without Spark; rows are (turn, role, text) before the damage."""
    conv, original = rows
    damaged = []
    for turn, role, text in original:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in damaged:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in damaged]
    cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
    left, at, length = [], 0, sum(c != "D" for c in audit)
    pattern = ("s" if length % 2 else "") + "ua" * (length // 2)
    for letter in audit:
        row = None if letter == "I" else damaged[at]
        at += letter != "I"
        if letter != "D":
            own = pattern[len(left)]
            left.append(f"{row[1]}:{row[2]}" if letter == "K" else f"{ {'u': 'user', 'a': 'assistant'}[own]}:{row[2] if row else ''}")
    turns = [r[0] for r in damaged if r[0] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(left).encode()).hexdigest(),
    }


def check(spark, rows, schema=FIELDS):
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = {}
    for r in dialogue.digest(dialogue.repair(dialogue.damage(df))).collect():
        assert r.conv_id not in found
        found[r.conv_id] = r.asDict()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:4])
    assert set(found) == set(groups)
    for conv, group in groups.items():
        assert found[conv] == {"conv_id": conv, **expected((conv, group))}, conv


@pytest.mark.parametrize("end", [0, 7])
def test_survivors_equal_looking_back(end):
    rng = random.Random(end)
    for _ in range(1500):
        rows = [(rng.choice("uuuasx"), rng.choices(("", "truncated", "blank", "duplicate"), (6, 2, 1, 1))[0]) for _ in range(rng.randint(0, 10 + end))]
        search, letters, cost = dialogue.Search(), "", 0
        for initial, fault in rows:
            code = ("", "blank", "duplicate", "truncated").index(fault)
            search.step((None, initial, "", code), initial, code)
            letters += "".join(n.letters for n in search.settled())
        final = min(c for s, c in search.cost.items() if s in (dialogue.START, dialogue.ASSISTANT))
        letters += "".join(n.letters for n in search.finish())
        assert (final, letters) == cheapest(tuple(rows))


def test_memory_holds_open_rows_alone():
    search, most, rng = dialogue.Search(), 0, random.Random(2)
    for i in range(20000):
        initial = rng.choice("us") if rng.random() < 0.05 else "ua"[i % 2]
        search.step((i, initial, "", 0), initial, 0)
        list(search.settled())
        waiting, depth = [search.root], 0
        while waiting:
            node = waiting.pop()
            depth += 1
            waiting += node.children
        most = max(most, depth)
    assert most < 400


def test_long_ties_take_linear_time():
    # Users alone leave two survivors apart from the first row on.
    search = dialogue.Search()
    for i in range(30000):
        search.step((i, "u", "", 0), "u", 0)
    assert "".join(n.letters for n in search.finish()) == "KR" * 15000


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice((0, 1, 1, 1, 1, 3))
            role = rng.choices(("user", "assistant", "system", "tool", "", None), (8, 8, 2, 1, 1, 1))[0]
            text = rng.choices(("Yes.", "No", "Why? ", " \n", "", None, "Då är det så!\v", "x" * 3000 + "."), (6, 3, 3, 1, 1, 1, 2, 1))[0]
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b.")]
    rows += [(900, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(150)]
    check(spark, rows)


def test_all_rows_lost_and_no_rows(spark):
    lost = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    check(spark, [(c, t, "user", "Hm.") for c, t in lost])
    empty = dialogue.digest(dialogue.repair(dialogue.damage(spark.createDataFrame([], FIELDS))))
    assert empty.count() == 0 and "audit" in empty.columns


def test_other_columns_and_texts_of_edits(spark):
    rows = [(1, 0, "user", "Hm.", "x", 1), (1, 1, "user", "Oh", "y", 2), (1, 2, "assistant", "Ja.", "z", 3)]
    df = spark.createDataFrame(rows, FIELDS + ", edit string, fault int")
    # Deleting costs what inserting a turn and leaving the open end would; D comes first.
    edits = [(r.edit, r.turn, r.role, r.text, r.fault, r.cost) for r in dialogue.repair(df).collect()]
    assert edits[0] == (None, None, None, None, None, 0)
    assert edits[1:] == [("K", 0, "user", "Hm.", 0, 0), ("D", 1, None, None, 3, 3), ("K", 2, "assistant", "Ja.", 0, 0)]
