from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import mixing


def slow_targets(sizes):
    """sizes: source to words. Shares the excess again and again, as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    excess = total
    while excess > 1e-9 and free:
        unit = excess / sum(weight[s] for s in free)
        excess = 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] > 2 * sizes[s]:
                excess += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                free.discard(s)
    return target


ROWS = [(i, "w " * (1 + i * 37 % 90), ["src1", "src0", "src0", "src0", None, "ß", "a", "zero"][i % 8]) for i in range(800)]
ROWS = [(i, "" if s == "zero" else t, s) for i, t, s in ROWS] + [(None, None, "a"), (3, "tie tie", "a"), (3, "tie tie", "a"), (900, "v " * 5000, "src0")]


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(3)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert [tuple(r) for r in sorted(out, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    source = {i: s for i, _, s in ROWS}
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    expect, taken = slow_targets(sizes), defaultdict(int)
    assert len(out) == len(ROWS)
    for r in out:
        s = "a" if r.doc_id in (None,) or (r.doc_id == 3 and r.size == 2) else source[r.doc_id] if r.doc_id != 3 else ROWS[3][2]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expect[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - expect[s]) <= 1 for s in sizes)
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert out[-1].position is None


def test_schedule_is_integrated(spark):
    """Of a source whose weight falls from 1.5 to 0.5, half of the time brings five eighths of the words."""
    rows = [(i, "w", s) for s in "abc" for i in range(3000)]
    out = mixing.mix(spark.createDataFrame([(i + 3000 * "abc".index(s), t, s) for i, t, s in rows], "doc_id long, text string, source string")).collect()
    places = [p for r in out if r.doc_id >= 6000 for p in r.positions]
    assert sum(p < 0.5 for p in places) / len(places) == pytest.approx(0.625, abs=0.01)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
