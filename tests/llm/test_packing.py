import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreloom.llm import packing


def slow_best_fit(sizes, gaps):
    """One piece at a time, each to the smallest gap that holds it; the gaps that are left, and the pieces."""
    gaps, left = sorted(gaps), []
    for size in sizes:
        at = next((k for k, g in enumerate(gaps) if g >= size), None)
        if at is None:
            left.append(size)
        else:
            gaps = sorted([*gaps[:at], *gaps[at + 1 :], gaps[at] - size])
    return [g for g in gaps if g], left


def test_a_range_equals_one_piece_at_a_time():
    rnd = random.Random(4)
    for _ in range(40):
        sizes = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(0, 60))), reverse=True)
        gaps = [rnd.choice((7, 25, 60, 100)) for _ in range(rnd.randint(0, 12))]
        runs, left, pools = packing.best_fit(np.array(sizes, np.int64), np.array(gaps, np.int64), np.arange(len(gaps)))
        slow_gaps, slow_left = slow_best_fit(sizes, gaps)
        assert sorted(g for g, p in pools.items() for _ in p) == slow_gaps and [sizes[i] for i in left] == slow_left
        fill = defaultdict(list)
        for first, n, size, gap, each, take in runs:
            assert sizes[first : first + n] == [size] * n
            for i in range(n):
                begin = gaps[take[i // each]] - gap + i % each * size
                fill[take[i // each]].append((begin, begin + size))
        for k, spans in fill.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= gaps[k] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_carry_follows_the_stack():
    got = packing.carried([(0, 0, 0, 3, 50), (1, 2, 20, 2, 9), (2, 9, 4, 0, 0), (3, 30, 1, 1, 1)])
    # part 1's two pieces of at most 20 share the top gap of part 0; part 2's nine of at most 4: two a gap of part 1, then part 0
    assert got == [(1, 0, 2, 2, 0, 2, 1), (2, 0, 4, 2, 1, 1, 2), (2, 4, 5, 12, 0, 1, 1), (3, 0, 30, 50, 0, 0, 1)]


def test_rounds_fill_sequences(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    mixed = np.minimum(4095, rnd.lognormal(5.8, 1.1, 4000).astype(int) + 1)
    for lengths, ranges in (([7] * 3000, 500), ([3000] * 10 + [1000] * 10, 4), ([1], 9), ([2049] * 50, 8), (mixed, 300), (mixed, 1 << 16), (rnd.integers(3, 40, 2000), 200)):
        monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
        units = spark.createDataFrame([(i, int(k)) for i, k in enumerate(lengths)], "id long, size long").repartition(3)
        out = packing.place_all(units).collect()
        assert sorted(r.id for r in out) == list(range(len(lengths)))
        fill = defaultdict(list)
        for r in out:
            fill[r.sequence].append((r.at, int(lengths[r.id])))
        for parts in fill.values():
            end = 0
            for at, k in sorted(parts):
                assert at == end
                end += k
            assert end <= 4096
        least = -(-int(np.sum(lengths)) // 4096)
        large = int((np.array(lengths) > 2048).sum())
        assert len(fill) <= max(least, large) * 1.01 + 1


def test_rounds_are_few_over_many_short_ranges(spark, monkeypatch):
    kind, deal, sweep = type(spark.range(0)), type(spark.range(0)).repartitionByRange, packing._swept
    rounds = []
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *order: deal(self, max(60, n), *order))
    monkeypatch.setattr(packing, "RANGE_ROWS", 4096)
    monkeypatch.setattr(packing, "_swept", lambda *a: rounds.append(a) or sweep(*a))
    lengths = np.minimum(4095, np.random.default_rng(3).lognormal(5.4, 1.0, 4000).astype(int) + 1).tolist()
    out = packing.place_all(spark.createDataFrame(list(enumerate(lengths)), "id long, size long")).collect()
    fill = Counter()
    for r in out:
        fill[r.sequence] += lengths[r.id]
    assert sorted(r.id for r in out) == list(range(4000)) and max(fill.values()) <= 4096
    assert len(fill) <= -(-sum(lengths) // 4096) * 1.01 + 1
    assert len(rounds) <= 5


def test_query_on_odd_rows(spark):
    texts = [None, "", "Hello World's 42 it'll", "a\x1cb   c d", "é É <|endoftext|> ΣΣ", "x " * 9000, "two", "two", "İ ﬁ ½ 한국어 🙂🙂", "word " * 4095, "word " * 4096]
    rows = [(i if i != 6 else None, t) for i, t in enumerate(texts)] + [(2, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("length", F.lit(1))
    out = packing.pack(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    expect = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * k + 4096]
            expect[i, k, 4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == expect
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        ends = [0]
        for at, k in sorted(parts):
            assert at == ends[-1]
            ends.append(at + k)
        assert ends[-1] <= 4096
    assert len(fill) == -(-sum(r.length for r in out) // 4096)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
