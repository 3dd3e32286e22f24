"""Suppression by rounds against going through all boxes in order."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import crowd, frames

SCHEMA = "frame string, idx long, score double, x1 double, y1 double, x2 double, y2 double"


def greedy(rows, threshold):
    kept = {}
    for f, i, s, *c in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True):
        def over(o):
            side = lambda lo, hi: max(hi - lo + 1, 0)
            area = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
            inter = side(max(c[0], o[0]), min(c[2], o[2])) * side(max(c[1], o[1]), min(c[3], o[3]))  # noqa: B023
            return inter / (area(c) + area(o) - inter)  # noqa: B023

        if not any(over(o) > threshold for _, o in kept.get(f, [])):
            kept.setdefault(f, []).append((i, c))
    return sorted((f, i) for f, found in kept.items() for i, _ in found)


def boxes(n, seed, size, spread):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = draw.uniform(-spread, spread), draw.uniform(-spread, spread)
        w, h = (size * 2 ** draw.uniform(-2, 2) for _ in range(2))
        rows.append((draw.choice("aaab"), i, float(draw.randint(0, 50)), x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.9])
def test_equals_going_through_in_order(spark, threshold):
    rows = boxes(500, 3, 20.0, 60.0) + [("same", i, 1.0, 5.0, 5.0, 9.0, 9.0) for i in range(60)] + [("dots", i, float(i), float(i % 7), 0.0, float(i % 7), 0.0) for i in range(30)]
    frame, expected = spark.createDataFrame(rows, SCHEMA).repartition(4), greedy(rows, threshold)
    for batch in (150, 1 << 14):
        assert sorted((r.frame, r.idx) for r in crowd.suppress(frame, threshold, batch=batch).collect()) == expected


def test_equals_the_fold_of_one_array(spark):
    rows = spark.createDataFrame(boxes(200, 5, 15.0, 40.0), SCHEMA)
    box = F.struct("score", "idx", "x1", "y1", "x2", "y2")
    fold = rows.groupBy("frame").agg(F.collect_list(box).alias("b")).select("frame", F.explode(frames.nms(F.col("b"), 0.3)).alias("idx"))
    assert sorted(map(tuple, crowd.suppress(rows, 0.3).collect())) == sorted(map(tuple, fold.collect()))


def test_a_very_crowded_frame(spark):
    """100,000 boxes in one frame, most of them on top of each other: the same from batches of different sizes."""
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(300)).cast("double") for k in (1, 2))
    rows = spark.range(100_000).select(F.lit("a").alias("frame"), F.col("id").alias("idx"), F.pmod(F.xxhash64("id"), F.lit(9_973)).cast("double").alias("score"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("id") % 9).alias("x2"), (y + 25).alias("y2"))
    few, many = (sorted(r.idx for r in crowd.suppress(rows, 0.4, batch=b).collect()) for b in (20_000, 200_000))
    assert few == many and 100 < len(few) < 2_000


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9])
def test_an_undecided_box_stands_in_one_cell(spark, threshold):
    """And every box that it conflicts with reaches that cell, once."""
    rows = spark.createDataFrame(boxes(300, 9, 20.0, 60.0), SCHEMA)
    home = crowd._at_home(rows)
    assert home.count() == 300
    pairs = lambda a: a.where(crowd._overlap({c: F.col(c) for c in crowd.CORNERS}, {c: F.col(f"b_{c}") for c in crowd.CORNERS}) > threshold)
    named = lambda df: df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))
    near, every = named(crowd._in_reach(rows, threshold)), named(rows)
    met = home.join(near, (F.col("level") == F.col("b_level")) & (F.col("cx") == F.col("b_cx")) & (F.col("cy") == F.col("b_cy")))
    found = sorted((r.idx, r.b_idx) for r in pairs(met).select("idx", "b_idx").collect())
    assert found == sorted((r.idx, r.b_idx) for r in pairs(rows.crossJoin(every)).select("idx", "b_idx").collect()) and len(found) >= 300


def test_odd_boxes(spark):
    rows = [("a", 1, 0.5, 0.0, 0.0, 9.0, 9.0), ("a", 1, 0.9, 0.0, 0.0, 9.0, 9.0), ("a", 2, 0.7, 0.0, 0.0, 9.0, 9.0), ("a", 3, None, 50.0, 0.0, 59.0, 9.0), ("a", 4, 0.1, 90.0, None, 99.0, 9.0), ("a", 5, 0.2, 70.0, 0.0, 60.0, 9.0), (None, 6, 0.2, 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("level", F.lit("clash"))
    assert [tuple(r) for r in crowd.suppress(frame, 0.5).collect()] == [("a", 1)]
    assert crowd.suppress(frame.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        crowd.suppress(frame, 1.0)
