import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scoreloom.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def slow_components(fps):
    """fps: id to fingerprint; id to smallest id reachable over pairs at most 3 bits apart."""
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_equals_brute_force():
    for text in (None, "", "One", "ÀB two", "a B c", " a\tb\nc d\x0be  f ", "x " * 50, "é b c d " * 9 + "z"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def groups_of(n, links):
    """Union-find over links of places."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in links:
        up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def slow_links(fps):
    """All pairs, a row of the matrix at a time."""
    return [(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3)]


def in_order(fps):
    fps = np.unique(fps)
    return fps[np.argsort(simhash.gray_rank(fps))]


def planted(rnd, n, bits, near):
    """Random codes of so many bits, some with copies up to three bits away."""
    fps = rnd.integers(0, 2**bits, n).astype(np.uint64)
    copies = fps[rnd.integers(0, n, near)]
    for _ in range(3):
        copies = copies ^ (np.uint64(1) << rnd.integers(0, bits, near).astype(np.uint64))
    return np.concatenate([fps, copies])


def test_gray_neighbours_differ_in_one_bit():
    codes = in_order(np.arange(4096).astype(np.uint64))
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()
    fps = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for t in range(4):
        assert (simhash.turned(fps, t) >> np.uint64(48) == (fps >> np.uint64(48 - 16 * t)) & np.uint64(0xFFFF)).all()


def test_tree_equals_brute_force():
    rnd = np.random.default_rng(3)
    for n, bits, near in ((1, 48, 0), (2, 2, 0), (17, 40, 5), (500, 48, 60), (4000, 48, 300), (3000, 12, 0), (2000, 20, 100)):
        fps = in_order(planted(rnd, n, bits, near))
        found = simhash.tree_links(fps)
        assert groups_of(len(fps), found) == groups_of(len(fps), slow_links(fps)) and len(found) < max(1, len(fps))
    for n, m, bits in ((3000, 700, 22), (1, 90, 6), (400, 1, 9)):
        x, y = in_order(planted(rnd, n, bits, 9)), in_order(planted(rnd, m, bits, 9))
        slow = [(i, len(x) + int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ y) <= 3)]
        assert groups_of(len(x) + len(y), simhash.tree_links(x, y)) == groups_of(len(x) + len(y), slow)


def same_groups(spark, fps):
    signed = fps.view(np.int64)
    distinct = spark.createDataFrame([(int(f),) for f in signed], "fp long").repartition(3)
    found = {r.node: r.label for r in simhash.components(simhash.links(distinct)).collect()}
    slow = {}
    for f, g in zip(signed.tolist(), groups_of(len(fps), slow_links(fps)), strict=True):
        slow.setdefault(g, set()).add(f)
    groups = {}
    for f in signed.tolist():
        groups.setdefault(found.get(f, f), set()).add(f)
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_links_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    full = np.unique(np.concatenate([planted(rnd, 3000, 63, 400), planted(rnd, 200, 9, 0), np.array([0, 2**64 - 1], np.uint64)]))
    assert same_groups(spark, full)


def test_one_upper_node_with_thousands_of_codes(spark):
    """All codes share their first 16 bits, and none of them another block, so one node has them all."""
    fps = np.unique(planted(np.random.default_rng(6), 20_000, 48, 800)) | np.uint64(0xABCD << 48)
    assert same_groups(spark, fps)


def test_links_over_blocks_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 60)
    monkeypatch.setattr(simhash, "BLOCK", 25)
    rnd = np.random.default_rng(7)
    fps = np.unique(np.concatenate([planted(rnd, 2600, 48, 300), planted(rnd, 50, 64 - 1, 9), planted(rnd, 600, 10, 0)]))
    assert same_groups(spark, fps)


def test_query_on_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    near = " ".join(f"v{i}" for i in range(400))
    rows = [(5, "a b c d"), (3, "A b  c\td"), (9, None), (8, ""), (7, long), (7, long), (None, "lone words here"), (None, near), (20, near), (21, near + " tail"), (22, "other text altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    fps = {i: slow_fingerprint(t) for i, (_, t) in enumerate(rows)}
    comp = slow_components(fps)
    ids = {}
    for i, c in comp.items():
        ids.setdefault(c, []).append(rows[i][0])
    expect = [(rows[i][0], f"{fps[i]:016x}", min((x for x in ids[comp[i]] if x is not None), default=None)) for i in fps]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(expect, key=key)
    kept = sorted(simhash.keep_one_each(docs).select("doc_id", "fp").collect(), key=lambda r: (r[0] is None, r[0]))
    first = {min(((x is None, x or 0) for x in found)) for found in ids.values()}
    assert [(r[0] is None, r[0] or 0) for r in kept] == sorted(first)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one_each(docs).count() == 0
