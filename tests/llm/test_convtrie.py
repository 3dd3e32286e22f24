"""Nodes against a dictionary of all beginnings; groups that are split; odd rows."""

import hashlib
import random
import zlib

import pytest

from scoreloom.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every beginning of every rebuilt conversation as a key."""
    convs = {}
    for c, n, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((n is not None, n or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - c % 100 if c >= 0 else c + (-c) % 100
        built[c] = [*turns.get(rest, [])[:h], *own[h:]]
    nodes = {(): set()} if built else {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), set()).add(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if tuple(built[c]) == key)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def conversations(seed, ids, longest=7):
    draw = random.Random(seed)
    rows = []
    for c in ids:
        for n in range(draw.randint(1, longest)):
            rows.append((c, n, draw.choice(["user", "user", "assistant", None]), draw.choice(["a", "bé", None, "", "same", "same"])))
    return rows


@pytest.mark.parametrize("limit", [1 << 16, 40, 1])
def test_nodes_equal_all_beginnings(spark, limit):
    rows = conversations(1, [*range(0, 60), *range(100, 130), *range(205, 215), -3, -205, 9_000_000_000_001])
    got = convtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), group_turns=limit)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, "user", "x"), (0, 1, "user", "y"), (0, 1, "user", "y"), (0, 1, "user", "a"), (None, 0, "user", "z"), (0, None, None, None), (105, 0, None, ""), (7, 3, "user", "x" * 50_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, path string")
    assert sorted(repr(tuple(r)) for r in convtrie.trie(frame).collect()) == brute(rows)
    empty = convtrie.trie(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
    # 104 has one turn, takes some of a conversation that is absent, and so keeps none: the root alone
    assert zlib.crc32(b"104") % 6 >= 1
    alone = convtrie.trie(spark.createDataFrame([(104, 0, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in alone] == [(104, 0, None, 1, 0, 1, 0, hashlib.sha256(b"104").hexdigest())]


def test_copies_and_one_first_turn(spark):
    """Most conversations are copies of one, across blocks of ids, and all begin alike."""
    rows = [(c, n, "user", f"{n}" if c % 3 else f"{n}{c % 7 if n > 2 else ''}") for c in range(4000, 4300) for n in range(5)]
    rows += [(c, n, "user", f"{n}") for c in range(9000, 9040) for n in range(5)]
    expected = brute(rows)
    for limit in (100, 1 << 16):
        got = convtrie.trie(spark.createDataFrame(rows, SCHEMA), group_turns=limit)
        assert sorted(repr(tuple(r)) for r in got.collect()) == expected


def test_a_deep_conversation(spark):
    rows = [(100, n, "user", str(n)) for n in range(3000)] + [(200, n, "user", str(n)) for n in range(2990)]
    got = {(r.conv_id, r.depth): r for r in convtrie.trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 3001 and got[100, 2990].n_convs == 2 and got[100, 3000].n_leaves == 1 and got[100, 0].n_leaves == 1
