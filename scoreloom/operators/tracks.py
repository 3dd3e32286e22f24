"""Ordered operators on tracks of any length: the same results as ``frames`` gives, with one item spread over many tasks.

Rows are range-partitioned by item and order. In each range, running fills and places are taken for the part of an item that
lies in it; an item that spans several ranges then gets what its other ranges carry: how many rows come before, the last
find before and the first find after. That is a row for each range that shares an item with another, two a range at most,
so it is broadcast whatever the tables' size. Windows of a few rows to either side read blocks of places, into which the
rows near a block's edges are copied.

Nulls and odd cases: rows without an item are an item of their own; rows that share an item and an order stand in the order
of their values, nulls first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import BOX, FRAME, ITEM
from .settle import settle

#: Rows of a range, about, and places of a block.
RANGE_ROWS, BLOCK = 1 << 17, 1 << 16
#: Frames that a mouth or talking-face track is smoothed over, and frames with a face that it needs.
MARGIN, LEAST_FACES = 12, 25


def _in_ranges(rows: DataFrame, value: str, order: list[str], n: int) -> DataFrame:
    """``rows`` in ``n`` ranges (_band) with place (_here), rows (_n) and nearest finds (_back, _ahead) in the item's part of
    the range. What lies ahead is read from the end: a frame that reaches to the end would be gone through for each row."""
    rows = rows.repartitionByRange(n, ITEM, *order).withColumn("_band", F.spark_partition_id())
    up = Window.partitionBy(ITEM, "_band").orderBy(*order, value)
    down = Window.partitionBy(ITEM, "_band").orderBy(F.desc("_here")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.row_number().over(up).cast("long") - 1)
    find = F.when(F.col(value).isNotNull(), F.struct(F.col("_here").alias("place"), F.col(value).alias("value")))
    rows = rows.withColumn("_back", F.last(find, True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumns({"_ahead": F.last(find, True).over(down), "_n": F.first("_here").over(down) + 1})


def placed(rows: DataFrame, value: str = BOX, order: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with each one's place in its item (from 0), the item's size, and the nearest find (a value that isn't null) at
    or before it and at or after it: back and ahead, structs of place and value, null where there is none."""
    order = order or [FRAME]
    names = rows.columns
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // range_rows))
    rows = settle(_in_ranges(rows, value, order, n))
    found = F.when(F.col(value).isNotNull(), F.struct(F.col("_here").alias("place"), F.col(value).alias("value")))
    parts = rows.groupBy(ITEM, "_band").agg(F.count("*").alias("n"), F.min_by(found, F.when(found.isNotNull(), F.col("_here"))).alias("first"), F.max_by(found, F.when(found.isNotNull(), F.col("_here"))).alias("last"))
    item, bands = Window.partitionBy(ITEM), Window.partitionBy(ITEM).orderBy("_band")
    parts = parts.withColumn("bands", F.count("*").over(item)).where("bands > 1").withColumns({"before": F.sum("n").over(bands) - F.col("n"), "size": F.sum("n").over(item)})
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.place") + F.col("before")).alias("place"), F.col(f"{c}.value").alias("value")))
    parts = parts.withColumns({"first": moved("first"), "last": moved("last")})
    carried = {"from_before": F.last("last", True).over(bands.rowsBetween(Window.unboundedPreceding, -1)), "from_after": F.first("first", True).over(bands.rowsBetween(1, Window.unboundedFollowing))}
    parts = parts.withColumns(carried).select(F.col(ITEM).alias("_item"), F.col("_band").alias("_part"), "before", "size", "from_before", "from_after")
    same = F.col(ITEM).eqNullSafe(F.col("_item")) & (F.col("_band") == F.col("_part"))
    out = rows.join(F.broadcast(parts), same, "left")  # at most two rows for each range
    start = F.coalesce("before", F.lit(0).cast("long"))
    own = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.place") + start).alias("place"), F.col(f"{c}.value").alias("value")))
    return out.select(
        *names, (F.col("_here") + start).alias("place"), F.coalesce("size", "_n").alias("size"),
        F.coalesce(own("_back"), F.col("from_before")).alias("back"), F.coalesce(own("_ahead"), F.col("from_after")).alias("ahead"),
    )


def fill_nearest(frames: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``frames.fill_nearest``, with place and size."""
    rows = placed(frames.select(ITEM, FRAME, BOX), range_rows=range_rows).where("back is not null or ahead is not null")
    earlier = F.coalesce(F.col("place") - F.col("back.place") <= F.col("ahead.place") - F.col("place"), F.col("ahead").isNull())
    return rows.select(ITEM, FRAME, F.when(earlier, F.col("back.value")).otherwise(F.col("ahead.value")).alias("filled"), "place", "size")


def forward_fill(frames: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``frames.forward_fill``, with place and size; where nothing is found before, what follows first is the first find."""
    return placed(frames.select(ITEM, FRAME, BOX), range_rows=range_rows).select(ITEM, FRAME, F.coalesce("back.value", "ahead.value").alias("filled"), "place", "size")


def _blocks(track: DataFrame, reach: int, block: int) -> DataFrame:
    """Each row in the block of its place, and copies of it in the blocks that begin or end within ``reach`` rows of it."""
    if block <= reach:
        raise ValueError("a block must have more rows than a window reaches")
    at = lambda place: F.floor(place / block).cast("long")
    least, most = F.greatest(at(F.col("place") - reach), F.lit(0).cast("long")), at(F.least(F.col("place") + reach, F.col("size") - 1))
    return track.withColumn("_home", at(F.col("place"))).withColumn("_block", F.explode(F.sequence(least, most)))


def median_smooth(track: DataFrame, value: str, width: int = 13, block: int = BLOCK) -> DataFrame:
    """``frames.median_smooth`` of a track that has place and size; with the place."""
    reach = width // 2
    rows = _blocks(track.select(ITEM, FRAME, value, "place", "size"), reach, block)
    order = Window.partitionBy(ITEM, "_block").orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"near": F.collect_list(value).over(order.rowsBetween(-reach, reach)), "first": F.first(value).over(whole), "last": F.last(value).over(whole)})
    # only where a window goes beyond the track are the ends looked at; the block then has them
    before, after = F.greatest(F.lit(0), F.lit(reach) - F.col("place")), F.greatest(F.lit(0), F.col("place") + reach + 1 - F.col("size"))
    every = F.concat(F.array_repeat("first", before.cast("int")), "near", F.array_repeat("last", after.cast("int")))
    return rows.where("_block = _home").select(ITEM, FRAME, F.element_at(F.array_sort(every), reach + 1).alias("smooth"), "place")


def sliding_mean(track: DataFrame, value: str, width: int, shrink: bool = False, block: int = BLOCK) -> DataFrame:
    """``frames.sliding_mean`` of a track that has place and size: the mean of a frame and the next ``width - 1``, the tail
    keeping the last full mean; with the place. Items of fewer frames are left out, or with ``shrink`` have the mean of all of them."""
    rows = _blocks(track.select(ITEM, FRAME, value, "place", "size"), width - 1, max(block, 2 * width))
    order = Window.partitionBy(ITEM, "_block").orderBy("place")
    full = F.when(F.col("place") + width <= F.col("size"), F.avg(value).over(order.rowsBetween(0, width - 1)))
    if shrink:
        full = F.when((F.col("size") < width) & (F.col("place") == 0), F.avg(value).over(order.rowsBetween(0, width - 1))).otherwise(full)
    else:
        rows = rows.where(F.col("size") >= width)
    rows = rows.withColumn("_full", full)
    return rows.withColumn("mean", F.last("_full", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_block = _home").select(ITEM, FRAME, "mean", "place")


def rate_remap(frames: DataFrame, fps: float, to: float, most: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``frames.rate_remap``, of the first ``most`` steps alone if that is given."""
    last = frames.groupBy(ITEM).agg(F.max(FRAME).cast("long").alias("last"))
    ends = F.ceil((F.col("last") + 1) / fps * to).cast("long")
    ends = F.least(ends, F.lit(most - 1).cast("long")) if most else ends
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(ends / BLOCK).cast("long"))).alias("run")
    runs = last.select(ITEM, "last", ends.alias("ends"), runs).repartition(ITEM, "run")  # an item's steps come from many tasks
    steps = runs.select(ITEM, F.explode(F.sequence(F.col("run") * BLOCK, F.least(F.col("run") * BLOCK + BLOCK - 1, F.col("ends")))).alias("step"), "last")
    steps = steps.withColumn("at", F.floor(F.col("step").cast("double") / to * fps).cast("long")).where("at <= last")
    none = F.lit(None).cast("long")
    rows = steps.select(ITEM, "at", F.lit(0).alias("kind"), "step", none.alias("frame"))
    rows = rows.unionByName(frames.select(ITEM, F.col(FRAME).cast("long").alias("at"), F.lit(1).alias("kind"), none.alias("step"), F.col(FRAME).cast("long").alias("frame")))
    return placed(rows, "frame", ["at", "kind"], range_rows).where("kind = 0").select(ITEM, "step", F.col("ahead.value").alias("frame"))


# --- loaders ------------------------------------------------------------------------------------------------------
def mouth_inputs(found: DataFrame, items: DataFrame, least: int = LEAST_FACES, margin: int = MARGIN, short_ok: bool = False) -> DataFrame:
    """(item_id, n_frames, faced, status) for each of ``items``: no_face below ``least`` frames with a find, else too_short
    below ``margin`` frames, unless a track may be shorter than it is smoothed over (``short_ok``, as for talking faces)."""
    counts = found.groupBy(ITEM).agg(F.count("*").alias("n_frames"), F.count(BOX).alias("faced"))
    rows = items.select(ITEM).join(counts, ITEM, "left").fillna(0, ["n_frames", "faced"])
    short = F.lit(False) if short_ok else F.col("n_frames") < margin
    return rows.withColumn("status", F.when(F.col("faced") < F.greatest(F.lit(least), F.lit(1)), "no_face").when(short, "too_short").otherwise("ok"))


def mouth_frames(found: DataFrame, inputs: DataFrame, margin: int = MARGIN, short_ok: bool = False, range_rows: int = RANGE_ROWS, block: int = BLOCK) -> DataFrame:
    """(item_id, frame_index, mark, smooth) of the items whose status is ok: the mark that a frame has or takes from the one
    before it (a leading gap from the first), and the mean over the next ``margin`` frames that its picture is warped by."""
    ready = inputs.where("status = 'ok'").select(ITEM)
    track = settle(forward_fill(found.join(ready, ITEM, "left_semi"), range_rows))
    smooth = sliding_mean(track, "filled", margin, short_ok, block).select(ITEM, "place", F.col("mean").alias("smooth"))
    return track.select(ITEM, FRAME, F.col("filled").alias("mark"), "place").join(smooth, [ITEM, "place"]).drop("place")


def mouth_audio(inputs: DataFrame, audio: DataFrame) -> DataFrame:
    """(item_id, n_frames, samples, status): mouths with the whole audio track of their item; ``audio(item_id, samples,
    audio_status)``. What the mouths lack decides first; an item without an audio row has no_audio."""
    rows = inputs.join(audio, ITEM, "left")
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce("audio_status", F.lit("no_audio")))
    ok = status == "ok"
    return rows.select(ITEM, F.when(ok, F.col("n_frames")).alias("n_frames"), F.when(ok, F.col("samples")).alias("samples"), status.alias("status"))


def spread_starts(n: Column, count: int, length: int) -> Column:
    """Where ``count`` windows of ``length`` frames begin, evenly over ``n`` frames; several alike in a short track."""
    top = n.cast("double") - length - 1
    step = top / (count - 1) if count > 1 else top
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when((i == count - 1) & (i > 0), top).otherwise(i * step).cast("long"))
