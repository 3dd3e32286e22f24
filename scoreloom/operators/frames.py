"""Ordered operators on frames of an item: fills, smoothing, windows, and which frames to sample.

All windows are partitioned by item, whose frames are bounded by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM, FRAME, BOX = "item_id", "frame_index", "box"


def _order(item: str = ITEM, frame: str = FRAME):  # noqa: ANN202
    return Window.partitionBy(item).orderBy(frame)


def with_place(frames: DataFrame) -> DataFrame:
    return frames.withColumn("place", F.row_number().over(_order()) - 1)


def fill_nearest(frames: DataFrame) -> DataFrame:
    """Frames without a box take that of the nearest frame that has one, the earlier of two; items without any are left out."""
    w = _order()
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, Window.partitionBy(ITEM).orderBy(F.desc("place"))))
    spot = F.when(F.col(BOX).isNotNull(), F.struct("place", BOX))
    rows = with_place(frames).withColumn("b", F.last(spot, True).over(back)).withColumn("a", F.last(spot, True).over(ahead))
    earlier = F.coalesce(F.col("place") - F.col("b.place") <= F.col("a.place") - F.col("place"), F.col("a").isNull())
    return rows.where("a is not null or b is not null").select(ITEM, FRAME, F.when(earlier, F.col(f"b.{BOX}")).otherwise(F.col(f"a.{BOX}")).alias("filled"))


def forward_fill(frames: DataFrame) -> DataFrame:
    """The last box seen; a leading gap takes the first one."""
    w = _order()
    last = F.last(BOX, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(BOX, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.select(ITEM, FRAME, F.coalesce(last, first).alias("filled"))


def median_smooth(track: DataFrame, value: str, width: int = 13) -> DataFrame:
    """Running median of an odd width; beyond its ends a track repeats its end values."""
    reach = width // 2
    w = _order()
    values = F.collect_list(value).over(w.rowsBetween(-reach, reach))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = track.withColumns({"place": F.row_number().over(w), "size": F.count("*").over(Window.partitionBy(ITEM)), "near": values, "first": F.first(value).over(whole), "last": F.last(value).over(whole)})
    before, after = F.greatest(F.lit(0), F.lit(reach + 1) - F.col("place")), F.greatest(F.lit(0), F.col("place") + reach - F.col("size"))
    every = F.concat(F.array_repeat("first", before.cast("int")), "near", F.array_repeat("last", after.cast("int")))
    return rows.select(ITEM, FRAME, F.element_at(F.array_sort(every), reach + 1).alias("smooth"))


def sliding_mean(track: DataFrame, value: str, width: int) -> DataFrame:
    """Mean of a frame and the next ``width - 1``; the tail keeps the last full mean; items of fewer frames are left out."""
    w = _order()
    mean = F.avg(value).over(w.rowsBetween(0, width - 1))
    full = F.count("*").over(w.rowsBetween(0, width - 1)) == width
    rows = track.withColumn("mean", F.when(full, mean))
    return rows.select(ITEM, FRAME, F.last("mean", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mean")).where("mean is not null")


def frame_groups(frames: DataFrame, size: int) -> DataFrame:
    """(item, group, first, last, n): runs of ``size`` frames that don't overlap; what is left over is dropped."""
    rows = with_place(frames).withColumn("group", F.floor(F.col("place") / size).cast("long"))
    return rows.groupBy(ITEM, "group").agg(F.min(FRAME).alias("first"), F.max(FRAME).alias("last"), F.count("*").alias("n")).where(F.col("n") == size)


def clip_starts(length: Column, clip: int, stride: int) -> Column:
    """Where windows of ``clip`` indices start, every ``stride``, in a track that is padded by ``clip - 1`` indices at both ends
    if it is shorter than a clip; null where it is empty."""
    size = F.when(length >= clip, length).when(length >= 1, length + 2 * (clip - 1))
    return F.when(size.isNotNull(), F.sequence(F.lit(0), size.cast("int") - clip, F.lit(stride)))


def clip_at(length: Column, start: Column, clip: int) -> Column:
    """The ``clip`` indices from ``start``; what a short track is padded by is its mirror image, over and over. From the
    start alone: slices of the whole track would copy it for each window."""
    length, period = length.cast("int"), F.greatest(2 * length.cast("int") - 2, F.lit(1))
    mirrored = F.transform(F.sequence(start - (clip - 1), start), lambda p: F.when(F.pmod(p, period) < length, F.pmod(p, period)).otherwise(period - F.pmod(p, period)))
    return F.when(length >= clip, F.sequence(start, start + (clip - 1))).otherwise(mirrored)


def clip_windows(length: Column, clip: int, stride: int) -> Column:
    """Windows of ``clip`` indices every ``stride`` into a track, which is padded by its mirror image at both ends if it is
    shorter than a clip; null where it is too short for that."""
    return F.transform(clip_starts(length, clip, stride), lambda start: clip_at(length, start, clip))


def segment_starts(samples: Column, window: int, least: int) -> Column:
    """Where windows over a waveform start: one after the other, and one more at the end if samples are left over; a clip up
    to one window is tiled (start 0); null below ``least``."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(samples / window).cast("long") - 1), lambda i: i * window)
    tail = F.when(F.pmod(samples, F.lit(window)) > 0, F.array(samples - window)).otherwise(F.array().cast("array<bigint>"))
    return F.when(samples < least, F.lit(None)).when(samples <= window, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(steps.cast("array<bigint>"), tail.cast("array<bigint>")))


def spread_frames(n: Column, k: int) -> Column:
    """``k`` indices evenly over ``n`` frames, rounded half to even; all of them if there are no more."""
    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i.cast("double") * (n - 1) / (k - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, every).otherwise(some)


def rate_frames(n: Column, fps: float, rate: float, most: int) -> Column:
    """Indices at ``rate`` a second, each once, at most ``most``."""
    ticks = F.ceil(n.cast("double") / fps * rate).cast("long")
    some = F.transform(F.sequence(F.lit(0).cast("long"), ticks - 1), lambda i: F.least(F.floor(i.cast("double") / rate * fps).cast("long"), n.cast("long") - 1))
    return F.when(n > 0, F.slice(F.array_sort(F.array_distinct(some)), 1, most)).otherwise(F.array().cast("array<bigint>"))


def window_frames(n: Column, windows: int, length: int) -> Column:
    """Indices of ``windows`` runs of ``length`` frames spread over ``n`` frames, each once, in order."""
    step = (n.cast("double") - length - 1) / (windows - 1)
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.floor(i.cast("double") * step).cast("long"))
    runs = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + length - 1)))
    return F.when(n > length, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))


def rate_remap(frames: DataFrame, fps: float, to: float) -> DataFrame:
    """(item, step, frame): the frame shown at each step of another rate: the first at or after its time, none beyond the
    last frame. Steps and frames are merged in one ordered pass, not joined by range."""
    last = frames.groupBy(ITEM).agg(F.max(FRAME).alias("last"))
    steps = last.select(ITEM, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("last") + 1) / fps * to).cast("long"))).alias("step"), "last")
    steps = steps.withColumn("wanted", F.floor(F.col("step").cast("double") / to * fps).cast("long")).where("wanted <= last")
    rows = steps.select(ITEM, F.col("wanted").alias("at"), F.lit(0).alias("kind"), "step", F.lit(None).cast("long").alias("frame"))
    rows = rows.unionByName(frames.select(ITEM, F.col(FRAME).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("step"), F.col(FRAME).cast("long").alias("frame")))
    ahead = Window.partitionBy(ITEM).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("frame", F.last("frame", True).over(ahead)).where("kind = 0").select(ITEM, "step", "frame")


def largest_box(boxes: DataFrame, area: str) -> DataFrame:
    """The largest box of each item, the first of equal ones."""
    return boxes.withColumn("_n", F.row_number().over(Window.partitionBy(ITEM).orderBy(F.col(area).desc_nulls_last(), FRAME))).where("_n = 1").drop("_n")


def nms(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over an array of structs (score, idx, x1, y1, x2, y2): kept idx from the highest score down."""

    def overlap(a: Column, b: Column) -> Column:
        side = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0.0))
        inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
        area = lambda x: (x["x2"] - x["x1"] + 1) * (x["y2"] - x["y1"] + 1)
        return inter / (area(a) + area(b) - inter)

    ordered = F.reverse(F.array_sort(boxes))
    kept = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))))
    return F.transform(kept, lambda k: k["idx"])
