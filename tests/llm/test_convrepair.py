"""Edits against a search over all of them; the whole query against plain code; odd rows and long conversations."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from scoreloom.llm import catalog, convrepair

SCHEMA = "conv_id long, turn long, role string, text string"
DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def best(turns):
    """(cost, letters, lines) of the cheapest edits, least letters first, by trying all edits at each place. turns: (role,
    text, must go, cut off)."""

    @functools.lru_cache(maxsize=None)
    def go(i, last, inserts):
        found = [(0, "", ())] if i == len(turns) and last in ("", "a") else []

        def then(cost, letter, line, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        due = DUE[last]
        name = {"u": "user", "a": "assistant"}[due]
        if inserts < 4:
            then(3, "I", (f"{name}:",), go(i, due, inserts + 1))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            then(4, "D", (), go(i + 1, last, 0))
            if not gone:
                initial = role[:1]
                if initial == due or (initial == "s" and last == ""):
                    then(3 * cut, "K", (f"{role}:{text}",), go(i + 1, initial, 0))
                then(3 + 3 * cut, "R", (f"{name}:{text}",), go(i + 1, due, 0))
        return min(found) if found else None

    return go(0, "", 0)


def brute(rows):
    convs = {}
    for c, n, role, text in rows:
        kept = convs.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if n is None else n}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(n is not None, n or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, kept in convs.items():
        kept = sorted(kept, key=lambda r: r[:2])
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, text in kept:
            words = text.strip(" \t\n\v\f\r")
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            turns.append((role, text, fault in (0, 1), fault == 2))
        numbers = [r[1] for r in kept if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, letters, lines = best(tuple(turns))
        out.append((c, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def check(spark, rows, extra=""):
    frame = spark.createDataFrame([(*r, *(["clash"] if extra else [])) for r in rows], SCHEMA + extra)
    assert sorted(repr(tuple(r)) for r in convrepair.repair(frame).collect()) == brute(rows)


def test_every_short_conversation():
    """All rows of up to four turns of each initial and fault, in one batch."""
    kinds = list(itertools.product("sua?", [(False, False), (True, False), (False, True)]))
    every = [t for n in range(5) for t in itertools.product(kinds, repeat=n)]
    every = every[:2000] + random.Random(3).sample(every[2000:], 3000)
    flat = [x for t in every for x in t]
    codes = np.array(["sua?".index(c) for c, _ in flat])
    gone, cut = (np.array([f[i] for _, f in flat]) for i in (0, 1))
    costs, edits = convrepair.repair_batch(np.array([len(t) for t in every]), codes, gone, cut)
    for t, cost, letters in zip(every, costs.tolist(), edits, strict=True):
        found = best(tuple((c, str(i), *f) for i, (c, f) in enumerate(t)))
        assert (cost, letters.decode()) == found[:2], t


def test_query_equals_plain_code(spark):
    draw = random.Random(8)
    texts = ["One. Two!", "no end", "End.  ", "", " \t\n", "Why?\v", "é.", "a\nb.", "...", None, "same.", "same."]
    rows = [(c, n * draw.choice([1, 1, 2]) + 100 * n, draw.choice(["user", "assistant", "system", "tool", "", None, "User", "user"]), draw.choice(texts)) for c in range(300) for n in range(draw.randint(1, 9))]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 0, "user", "Hi."), (1, None, "user", "A."), (1, None, "user", "A."), (1, -5, "assistant", "B."), (1, 7, "user", "x" * 60_000)]
    rows += [(4, 2, "user", "Once."), (4, 2, "user", "Once."), (9, 3, "system", "Only.")]
    check(spark, rows, ", code string")
    assert convrepair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    # a conversation all of whose rows are dropped
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = convrepair.repair(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversations_in_small_tensors(spark, monkeypatch):
    draw = random.Random(4)
    size = [0, 1, 700, 3, 64, 65, 700, 2]
    n = sum(size)
    codes, gone, cut = np.array(draw.choices(range(4), k=n)), np.array(draw.choices([False, False, True], k=n)), np.zeros(n, bool)
    whole = convrepair.repair_batch(np.array(size), codes, gone, cut)
    monkeypatch.setattr(convrepair, "_CELLS", 4)
    apart = convrepair.repair_batch(np.array(size), codes, gone, cut)
    assert whole[0].tolist() == apart[0].tolist() and whole[1] == apart[1]
    check(spark, [(c, t, draw.choice(["user", "assistant"]), f"{draw.random()}.") for c in (1, 2) for t in range(150)])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalog.queries()["op13_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)
