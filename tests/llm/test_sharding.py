import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scoreloom.llm import sharding


def checked(rows, out, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    load = Counter()
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_hot_text_and_long_text(spark):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(3000)] + [(i, "copied text " * 30) for i in range(3000, 6000)] + [(6000, "x" * 9000), (None, None), (7, "é"), (7, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("range", F.lit(1)).repartition(5)
    load = checked(rows, sharding.shard_by_bytes(docs).collect())
    mean = sum(load.values()) / 8
    assert max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean


def test_repeated_rows_are_divided(spark):
    hot = [(1, "the same row again " * 20)] * 4000 + [(None, "no id")] * 2000
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(2, 4000)] + hot
    load = checked(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean


def slow_shards(rows, shards, ranges, sample):
    """rows: (id, size, h, tie, draw); the same law one row at a time: id to (shard, slot)."""
    n, total = len(rows), sum(r[1] for r in rows)
    keys = sorted(r[2] for r in rows if r[4] < r[1] * sample / total)
    tiles, (least, more) = [], divmod(len(keys), ranges)
    for k in range(ranges):
        end = (tiles[-1] if tiles else 0) + least + (k < more)
        tiles.append(end)
    cuts = sorted({keys[e - 1] for b, e in zip([0, *tiles], tiles, strict=False) if e > b})
    load = defaultdict(lambda: [0, 0])
    of = [sum(c < r[2] for c in cuts) for r in rows]
    for k, r in zip(of, rows, strict=True):
        load[k][0] += r[1]
        load[k][1] += 1
    parts = {k: max(1, math.ceil(max(b * ranges / (2 * total), r * ranges / (2 * n)))) for k, (b, r) in load.items()}
    place = [(k, r[3] % parts[k]) for k, r in zip(of, rows, strict=True)]
    bytes_, counts = Counter(), Counter()
    for k, r in zip(place, rows, strict=True):
        bytes_[k] += r[1]
        counts[k] += 1
    assert all(bytes_[k] * ranges <= 2 * total and counts[k] * ranges <= 2 * n for k in bytes_)  # none is divided again
    shard, before = {}, 0
    for k in sorted(bytes_):
        shard[k] = min(shards - 1, int((before + bytes_[k] / 2) * shards / total))
        before += bytes_[k]
    out, filled = {}, Counter()
    for k, r in sorted(zip(place, rows, strict=True), key=lambda x: (x[0], x[1][2], x[1][3])):
        out[r[0]] = (shard[k], filled[shard[k]])
        filled[shard[k]] += 1
    return out


def test_assignment_equals_one_row_at_a_time(spark):
    rows = [(i, f"text {i if i % 4 else i % 40} " * (1 + i % 23)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))).alias("tie"))
    drawn = keyed.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "tie", "h"), 11) / F.lit(float(1 << 53)))
    slow = slow_shards([tuple(r) for r in drawn.collect()], 8, 64, 1500)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs, ranges=64, sample=1500).collect()}
    assert got == slow


def test_equal_texts_share_a_shard_unless_they_fill_a_range(spark):
    rows = [(i, f"text {i // 2} " * 9) for i in range(20_000)]
    shard = {r.doc_id: r.shard for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), ranges=256).collect()}
    assert sum(shard[i] != shard[i + 1] for i in range(0, 20_000, 2)) < 100


def test_empty_and_nulls_only(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, None)] * 40
    load = checked(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(load.values()) == 40
