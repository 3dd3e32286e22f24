"""Long tracks against the window form; ranges against brute force; loaders' statuses; plans."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import frames, lips, ranges, tracks

SCHEMA = "item_id string, frame_index long, box double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_long_item(n=700, others=40, seed=1):
    draw = random.Random(seed)
    rows = [("long", 3 * i + 1, draw.choice([None, None, float(draw.randint(0, 50))])) for i in range(n)]
    rows += [(f"s{k}", i, draw.choice([None, float(i)])) for k in range(others) for i in range(draw.randint(1, 30))]
    rows += [("none", i, None) for i in range(5)] + [("gap", i, 7.0 if i == 90 else None) for i in range(180)]
    draw.shuffle(rows)
    return rows


def same(ours, theirs):
    names = theirs.columns
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(names).collect())))
    assert key(ours) == key(theirs)


@pytest.mark.parametrize("range_rows", [20, 100_000])
def test_fills_equal_the_window_form(spark, range_rows):
    rows = spark.createDataFrame(one_long_item(), SCHEMA)
    near, ahead = tracks.fill_nearest(rows, range_rows), tracks.forward_fill(rows, range_rows)
    same(near, frames.fill_nearest(rows))
    same(ahead.select("item_id", "frame_index", "filled"), frames.forward_fill(rows))
    same(near.select("item_id", "frame_index", "place"), frames.with_place(rows).join(near.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "frame_index", "place"))
    assert {(r.item_id, r.size) for r in near.collect()} >= {("long", 700), ("gap", 180)}


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_windows_equal_the_window_form(spark, block):
    rows = spark.createDataFrame(one_long_item(), SCHEMA)
    filled = frames.fill_nearest(rows)
    track = tracks.fill_nearest(rows, 50)
    same(tracks.median_smooth(track, "filled", 13, block), frames.median_smooth(filled, "filled", 13))
    for width in (1, 2, 7):
        ours = tracks.sliding_mean(track, "filled", width, block=block).withColumn("mean", F.round("mean", 9))
        same(ours, frames.sliding_mean(filled, "filled", width).withColumn("mean", F.round("mean", 9)))
    with pytest.raises(ValueError, match="block"):
        tracks.median_smooth(track, "filled", 101, 50)


def test_remap_equals_the_window_form(spark):
    rows = spark.createDataFrame(one_long_item(), SCHEMA)
    for fps, to in ((24.0, 25.0), (30.0, 25.0), (10.0, 40.0)):
        same(tracks.rate_remap(rows, fps, to, range_rows=64), frames.rate_remap(rows, fps, to))
    first = tracks.rate_remap(rows, 24.0, 25.0, most=50)
    assert first.agg(F.max("step")).first()[0] == 49
    same(first, frames.rate_remap(rows, 24.0, 25.0).where("step < 50"))


def test_a_hot_item_is_spread_over_ranges_and_what_is_broadcast_is_small(spark):
    """One item has nearly all rows: no range holds more than its share, and two rows a range at most are carried."""
    rows = spark.range(40_000).select(F.lit("long").alias("item_id"), F.col("id").alias("frame_index"), F.when(F.col("id") % 9 == 0, F.col("id").cast("double")).alias("box"))
    rows = rows.unionByName(spark.range(500).select(F.concat(F.lit("s"), F.col("id")).alias("item_id"), F.lit(0).cast("long").alias("frame_index"), F.lit(1.0).alias("box")))
    placed = tracks.placed(rows, range_rows=2_000)
    parts = spark.createDataFrame(rows.repartitionByRange(21, "item_id", "frame_index").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    assert parts.agg(F.max("count")).first()[0] < 6_000
    got = placed.where("item_id = 'long'").agg(F.count("*"), F.max("place"), F.count_distinct("place"), F.max(F.abs(F.col("place") - F.col("back.place")))).first()
    assert tuple(got) == (40_000, 39_999, 40_000, 8)


def test_no_frame_reaches_to_the_end(spark):
    """A window frame from a row to its partition's end is gone through anew for each row: what lies ahead is read from the end."""
    rows = spark.createDataFrame(one_long_item(60, 3), SCHEMA)
    placed = tracks._in_ranges(rows.select("item_id", "frame_index", "box"), "box", ["frame_index"], 3)
    for made in (placed, frames.fill_nearest(rows), frames.rate_remap(rows, 24.0, 25.0)):
        shown = plan(made).lower()
        assert "unboundedpreceding" in shown and "unboundedfollowing" not in shown


def test_steps_of_many_runs_equal_the_window_form(spark, monkeypatch):
    monkeypatch.setattr(tracks, "BLOCK", 64)
    rows = spark.createDataFrame(one_long_item(), SCHEMA)
    same(tracks.rate_remap(rows, 24.0, 25.0, range_rows=64), frames.rate_remap(rows, 24.0, 25.0))
    assert tracks.rate_remap(rows, 24.0, 25.0, most=64).agg(F.max("step")).first()[0] == 63


def test_odd_tracks(spark):
    rows = [(None, 1, 2.0), (None, 3, None), ("a", 5, None), ("a", 5, 1.0), ("a", 5, 1.0), ("a", None, 4.0)]
    got = tracks.forward_fill(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert sorted(map(repr, ((r.item_id, r.frame_index, r.filled, r.place, r.size) for r in got))) == sorted(
        map(repr, [(None, 1, 2.0, 0, 2), (None, 3, 2.0, 1, 2), ("a", None, 4.0, 0, 4), ("a", 5, 4.0, 1, 4), ("a", 5, 1.0, 2, 4), ("a", 5, 1.0, 3, 4)])
    )
    empty = spark.createDataFrame([], SCHEMA)
    assert tracks.fill_nearest(empty).count() == tracks.rate_remap(empty, 24.0, 25.0).count() == 0


def test_mouths(spark):
    draw = random.Random(5)
    rows = [(f"n{n}", i, float(draw.randint(0, 9)) if draw.random() < p else None) for n, p in ((3, 1.0), (11, 1.0), (12, 1.0), (40, 0.7), (60, 0.1)) for i in range(n)]
    found = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(f"n{n}",) for n in (3, 11, 12, 40, 60)] + [("lost",)], "item_id string")
    inputs = tracks.mouth_inputs(found, items, least=3, margin=12)
    assert {r.item_id: r.status for r in inputs.collect()} == {"n3": "too_short", "n11": "too_short", "n12": "ok", "n40": "ok", "n60": "ok", "lost": "no_face"}
    talking = tracks.mouth_inputs(found, items, least=3, margin=12, short_ok=True)
    assert {r.status for r in talking.where("item_id in ('n3', 'n11')").collect()} == {"ok"}
    made = {}
    for r in tracks.mouth_frames(found, talking, 12, True, 16, 32).collect():
        made.setdefault(r.item_id, {})[r.frame_index] = (r.mark, round(r.smooth, 9))
    for item in ("n3", "n11", "n12", "n40", "n60"):
        boxes = [b for k, _, b in rows if k == item]
        last, marks = next(b for b in boxes if b is not None), []
        for b in boxes:
            last = last if b is None else b
            marks.append(last)
        width = min(12, len(marks))
        means = [sum(marks[i : i + width]) / width for i in range(len(marks) - width + 1)]
        assert made[item] == {i: (m, round(means[min(i, len(means) - 1)], 9)) for i, m in enumerate(marks)}
    audio = spark.createDataFrame([("n12", 5, "too_short"), ("n40", 90, "ok"), ("n3", 7, "ok")], "item_id string, samples long, audio_status string")
    heard = {r.item_id: (r.n_frames, r.samples, r.status) for r in tracks.mouth_audio(inputs, audio).collect()}
    assert heard["n40"] == (40, 90, "ok") and heard["n12"] == (None, None, "too_short") and heard["n3"][2] == "too_short" and heard["n60"][2] == "no_audio"


def test_interval_join_equals_all_pairs(spark):
    draw = random.Random(7)
    make = lambda n, most: [(draw.choice(["a", "a", "a", "b", None]), a, a + draw.choice([0, 1, 2, draw.randint(1, most)]), k) for k in range(n) for a in (draw.randint(-50, 400),)]
    left, right = make(150, 300), make(200, 9)
    right += [("a", -40, 390, 900), ("b", None, 4, 901), ("c", 0, 5, 902)]
    got = ranges.interval_join(spark.createDataFrame(left, "item_id string, a long, b long, l long"), spark.createDataFrame(right, "item_id string, c int, d int, r long"), ["item_id"], ("a", "b"), ("c", "d"))
    shown = plan(got)
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    pairs = sorted((x.l, x.r) for x in got.collect())
    assert pairs == sorted((p[3], q[3]) for p in left for q in right if p[0] is not None and p[0] == q[0] and q[1] is not None and max(p[1], q[1]) < min(p[2], q[2]))
    none = spark.createDataFrame([], "item_id string, a long, b long, l long")
    assert ranges.interval_join(none, spark.createDataFrame(right, "item_id string, c int, d int, r long"), ["item_id"], ("a", "b"), ("c", "d")).count() == 0


def test_long_ranges_touch_few_buckets(spark):
    """A range of a thousand million beside many short ones: rows grow by the other side's levels, not by its length."""
    long = spark.createDataFrame([("a", 0, 1_000_000_000)], "item_id string, a long, b long")
    short = spark.range(1000).select(F.lit("a").alias("item_id"), (F.col("id") * 999_983).alias("c"), (F.col("id") * 999_983 + 5).alias("d"))
    assert ranges._bucketed(long, "a", "b", [3], "_l").count() == 1
    assert ranges._bucketed(short, "c", "d", [30], "_r").count() <= 3000
    assert ranges.interval_join(long, short, ["item_id"], ("a", "b"), ("c", "d")).count() == 1000


def test_lip_windows_against_plain_code(spark):
    draw = random.Random(11)
    found, videos, audio = [], [], []
    for k in range(30):
        n = draw.choice([0, 3, 5, 6, 7, 40, 90])
        videos.append((f"v{k}", n))
        found += [(f"v{k}", i, 1.0 if draw.random() < 0.6 else None) for i in range(n) if draw.random() < 0.93]
        if draw.random() < 0.85:
            audio.append((f"v{k}", draw.choice([0, 100, 700, n * 640, n * 4000])))
    have, sound, windows, status = {}, dict(audio), [], {}
    for v, i, b in found:
        have.setdefault(v, {})[i] = b
    for v, n in videos:
        faced = sum(b is not None for b in have.get(v, {}).values())
        status[v] = "unreadable" if not n else "no_face" if faced < 3 else "no_audio" if v not in sound else None
        if status[v]:
            continue
        cols, top = 1 + sound[v] // 512, n - 5 - 1
        starts = [int(top if k == 9 else k * (top / 9)) for k in range(10)]
        kept = [(v, k, s, round(s * (cols / n)), round((s + 5) * (cols / n))) for k, s in enumerate(starts) if s >= 0 and all(s + j in have[v] for j in range(5))]
        kept = [w for w in kept if w[4] > w[3]]
        windows += kept
        status[v] = "ok" if kept else "too_short"
    f, vid, aud = spark.createDataFrame(found, SCHEMA), spark.createDataFrame(videos, "item_id string, n_frames long"), spark.createDataFrame(audio, "item_id string, samples long")
    got = lips.lip_windows(f, vid, aud, 3)
    assert sorted((r.item_id, r.nth, r.first, r.begin, r.end) for r in got.select("item_id", "nth", F.col("first"), "begin", "end").collect()) == sorted(windows)
    assert {r.item_id: r.status for r in lips.lip_inputs(got, f, vid, aud, 3).collect()} == status
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
