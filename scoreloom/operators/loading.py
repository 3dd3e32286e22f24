"""What a scorer's input is made of: which items have enough of it, and a status where they don't.

Detections are rows (item_id, frame_index, box), a null box being a sampled frame without a find. A status is ok, no_face or
what the audio says; the first thing that is missing decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_rank
from .frames import FRAME, ITEM

#: Frames with a face that a video and an image need.
VIDEO_FACES, IMAGE_FACES = 8, 1


def face_inputs(found: DataFrame, modality: DataFrame, video: int = VIDEO_FACES, image: int = IMAGE_FACES) -> DataFrame:
    """(item_id, sampled, faced, status): ``modality(item_id, modality)`` tells images from videos; an item without any
    sampled frame has no face."""
    counts = found.groupBy(ITEM).agg(F.count("*").alias("sampled"), F.count("box").alias("faced"))
    rows = modality.join(counts, ITEM, "left").fillna(0, ["sampled", "faced"])
    enough = F.col("faced") >= F.when(F.col("modality") == "image", image).otherwise(video)
    return rows.select(ITEM, "sampled", "faced", F.when(enough, "ok").otherwise("no_face").alias("status"))


def rate_count(n: Column, fps: Column, rate: float) -> Column:
    """How many frames ``rate`` a second gives over ``n`` frames at ``fps``, before any cap."""
    return F.when((n > 0) & (fps > 0), F.ceil(n / fps * rate)).otherwise(0).cast("long")


def audio_video(faces: DataFrame, audio: DataFrame, videos: DataFrame, rate: float) -> DataFrame:
    """(item_id, faced, samples, n_sampled, status): faces with the whole audio track of the same item. ``faces`` as from
    ``face_inputs``, ``audio(item_id, samples, audio_status)``, ``videos(item_id, n_frames, fps)``; an item without an
    audio row has no_audio."""
    rows = faces.join(videos, ITEM, "left").join(audio, ITEM, "left")
    heard = F.coalesce("audio_status", F.lit("no_audio"))
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(heard)
    n = F.coalesce(rate_count(F.col("n_frames"), F.col("fps"), rate), F.lit(0).cast("long"))
    return rows.select(ITEM, "faced", F.when(status == "ok", F.col("samples")).alias("samples"), n.alias("n_sampled"), status.alias("status"))


def whole_windows(found: DataFrame, length: int, step: int) -> DataFrame:
    """(item_id, first): the windows of ``length`` frames, one each ``step``, of which every frame has a find."""
    faced = found.where("box is not null").select(ITEM, F.col(FRAME).cast("long").alias("at"))
    # a frame stands in the windows that begin up to ``length`` frames before it
    least = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("at") - (length - 1)) / step).cast("long"))
    windows = faced.withColumn("window", F.explode(F.sequence(least, F.floor(F.col("at") / step).cast("long"))))
    whole = windows.groupBy(ITEM, "window").agg(F.count_distinct("at").alias("n")).where(F.col("n") == length)
    return whole.select(ITEM, (F.col("window") * step).alias("first"))


def chosen_row_groups(groups: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """``groups(folder, shard, row_group)``: at most ``most`` shards of each folder, those with the least hash, and of each the
    row group with the least hash of its name."""
    groups = groups.withColumn("named", F.concat_ws("#", "shard", F.col("row_group").cast("string")))
    rank = hash_rank(seed, "named")
    one = groups.groupBy("folder", "shard").agg(F.min(F.struct(rank.alias("rank"), "row_group")).alias("best"))
    order = Window.partitionBy("folder").orderBy(hash_rank(seed, "shard"), "shard")
    kept = one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return kept.select("folder", "shard", F.col("best.row_group").alias("row_group"))


def first_items(items: DataFrame, most: int, key: str = "item_id") -> DataFrame:
    """The ``most`` items that come first by ``key``: a bounded run for a look, not a sample."""
    return items.orderBy(key).limit(most)


def divergence_score(target: Column, logits: Column) -> Column:
    """Sigmoid of the mean over windows of each window's divergence of softmax(logits) from softmax(target): arrays of
    windows, each an array of logits."""

    def log_softmax(x: Column) -> Column:
        top = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return F.transform(x, lambda v: v - top - F.log(total))

    def divergence(p: Column, q: Column) -> Column:
        terms = F.zip_with(log_softmax(p), log_softmax(q), lambda a, b: F.exp(a) * (a - b))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    each = F.zip_with(target, logits, divergence)
    mean = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / F.size(each)
    return 1 / (1 + F.exp(-mean))
