"""Video windows and the stretch of audio under them: windows at two rates, joined as ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import BOX, FRAME, ITEM
from .ranges import interval_join
from .tracks import spread_starts

#: Frames of a window, windows of an item, samples of a spectrogram's column.
LENGTH, COUNT, HOP = 5, 10, 512


def columns_of(samples: Column, hop: int = HOP) -> Column:
    """Columns of a spectrogram that is centred on its samples."""
    return 1 + F.floor(samples / hop).cast("long")


def lip_windows(found: DataFrame, videos: DataFrame, audio: DataFrame, least: int, count: int = COUNT, length: int = LENGTH, hop: int = HOP) -> DataFrame:
    """(item_id, nth, first, begin, end): the windows that have all their frames and columns of sound. ``found`` has a row for
    each sampled frame (all of them count once an item has ``least`` with a find, since the others take the nearest box),
    ``videos(item_id, n_frames)``, ``audio(item_id, samples)``. begin and end are columns, rounded half to even."""
    faced = found.groupBy(ITEM).agg(F.count(BOX).alias("faced")).where(F.col("faced") >= max(least, 1))
    items = videos.where("n_frames > 0").join(audio, ITEM).join(faced, ITEM, "left_semi")
    scale = columns_of(F.col("samples"), hop).cast("double") / F.col("n_frames")
    rows = items.select(ITEM, scale.alias("scale"), F.posexplode(spread_starts(F.col("n_frames"), count, length)).alias("nth", "first"))
    column = lambda frame: F.bround(frame * F.col("scale")).cast("long")
    rows = rows.select(ITEM, "nth", "first", column(F.col("first")).alias("begin"), column(F.col("first") + length).alias("end"))
    rows = rows.where("end > begin and first >= 0").withColumn("stop", F.col("first") + length)
    frames = found.select(ITEM, F.col(FRAME).cast("long").alias("at"), (F.col(FRAME) + 1).cast("long").alias("next"))
    inside = interval_join(rows, frames, [ITEM], ("first", "stop"), ("at", "next"))
    whole = inside.groupBy(ITEM, "nth", "first", "begin", "end").agg(F.count_distinct("at").alias("n")).where(F.col("n") == length)
    return whole.drop("n")


def lip_inputs(windows: DataFrame, found: DataFrame, videos: DataFrame, audio: DataFrame, least: int) -> DataFrame:
    """(item_id, n_windows, status) for each video: unreadable without frames, no_face, no_audio, too_short without a whole
    window; the first that holds."""
    counts = found.groupBy(ITEM).agg(F.count(BOX).alias("faced"))
    n = windows.groupBy(ITEM).agg(F.count("*").alias("n_windows"))
    rows = videos.join(counts, ITEM, "left").join(audio, ITEM, "left").join(n, ITEM, "left").fillna(0, ["faced", "n_windows"])
    status = F.when(F.coalesce(F.col("n_frames"), F.lit(0)) <= 0, "unreadable").when(F.col("faced") < max(least, 1), "no_face")
    status = status.when(F.col("samples").isNull(), "no_audio").when(F.col("n_windows") == 0, "too_short").otherwise("ok")
    return rows.select(ITEM, "n_windows", status.alias("status"))


def audio_under_video(video: DataFrame, audio: DataFrame, fps: tuple[int, int], rate: int) -> DataFrame:
    """(item_id, first, length, start, samples, shared_s): each window of video frames with each window of audio samples that
    sounds during it, and for how many seconds. ``video(item_id, first, length)`` at ``fps`` (a fraction), ``audio(item_id,
    start, samples)`` at ``rate``. Both are put on one clock of whole ticks, so that nothing is rounded."""
    num, den = fps
    frame, sample = den * rate, num  # ticks of a frame and of a sample, of which there are num * rate a second
    left = video.withColumns({"v_from": F.col("first") * frame, "v_to": (F.col("first") + F.col("length")) * frame})
    right = audio.withColumns({"a_from": F.col("start") * sample, "a_to": (F.col("start") + F.col("samples")) * sample})
    pairs = interval_join(left, right, [ITEM], ("v_from", "v_to"), ("a_from", "a_to"))
    shared = (F.least("v_to", "a_to") - F.greatest("v_from", "a_from")) / (num * rate)
    return pairs.select(ITEM, "first", "length", "start", "samples", shared.alias("shared_s"))
