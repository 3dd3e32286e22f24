"""Queries over tracks of any length and windows at two rates; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crowd, frames, lips, tracks
from ..sources import tables as t
from ..sources.tables import crc_sql, with_views
from .detection import Query, rounded


# --- views --------------------------------------------------------------------------------------------------------
def line_track(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as frames: a third of all in one track, the rest in a track for each of up to fifty suppliers."""
    key = F.col("l_suppkey")
    item = F.when(key % 3 == 0, "track/all").otherwise(F.concat(F.lit("track/"), (key % 50).cast("string")))
    frame = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return t.table(spark, d, "lineitem").select(item.alias("item_id"), frame.alias("frame_index"), F.when(F.col("l_quantity") >= 30, F.col("l_extendedprice").cast("double")).alias("box"))


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as video frames in runs of 400, every third run following on in one long clip; purchases were not decoded."""
    run, at = F.floor(F.col("event_id") / 400).cast("long"), F.col("event_id") % 400
    long = run % 3 == 0
    item = F.when(long, "clip/all").otherwise(F.concat(F.lit("clip/"), run.cast("string")))
    frame = F.when(long, F.floor(run / 3).cast("long") * 400 + at).otherwise(at)
    rows = t.table(spark, d, "events").select(item.alias("item_id"), frame.alias("frame_index"), "event_type", F.when(F.col("value") > 20, F.col("value").cast("double")).alias("box"))
    return rows.where("event_type <> 'purchase'").drop("event_type")


def event_videos(spark: SparkSession, d: str) -> DataFrame:
    return event_frames(spark, d).groupBy("item_id").agg((F.max("frame_index") + 1).alias("n_frames"))


def event_audio(spark: SparkSession, d: str) -> DataFrame:
    """Some 640 samples a frame; every seventh clip is silent, every fifth very short."""
    n = F.crc32("item_id")
    samples = F.when(n % 5 == 1, 900).otherwise(F.col("n_frames") * 640 - n % 3000)
    return event_videos(spark, d).where(n % 7 != 3).select("item_id", F.greatest(samples, F.lit(0)).cast("long").alias("samples"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Four clips in five as items, and as many that have no frames."""
    clips = event_videos(spark, d).select("item_id").where(F.crc32("item_id") % 5 != 0)
    return clips.unionByName(clips.select(F.concat("item_id", F.lit("-lost")).alias("item_id")))


# --- long tracks --------------------------------------------------------------------------------------------------
def track_fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return tracks.fill_nearest(line_track(spark, d)).select("item_id", "frame_index", "filled", "place")


def track_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return tracks.forward_fill(line_track(spark, d)).select("item_id", "frame_index", "filled", "place")


def track_median(spark: SparkSession, d: str) -> DataFrame:
    return tracks.median_smooth(tracks.fill_nearest(line_track(spark, d)), "filled")


def track_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks.sliding_mean(tracks.forward_fill(line_track(spark, d)), "filled", 12))


def track_remap(spark: SparkSession, d: str) -> DataFrame:
    """The long clips at another rate."""
    return tracks.rate_remap(event_frames(spark, d), 24.0, 25.0)


# --- loaders ------------------------------------------------------------------------------------------------------
def _mouths(spark: SparkSession, d: str) -> DataFrame:
    return tracks.mouth_inputs(event_frames(spark, d), _clips(spark, d))


def mouth_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _mouths(spark, d)


def mouth_frames(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tracks.mouth_frames(event_frames(spark, d), _mouths(spark, d)))


def talking_frames(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as talking faces, most of them shorter than what a track is smoothed over."""
    found = t.conv_frames(spark, d)
    ready = tracks.mouth_inputs(found, found.select("item_id").distinct(), least=2, margin=4, short_ok=True)
    return rounded(tracks.mouth_frames(found, ready, margin=4, short_ok=True))


def mouth_audio(spark: SparkSession, d: str) -> DataFrame:
    audio = event_audio(spark, d).withColumn("audio_status", F.when(F.col("samples") < 1000, "too_short").otherwise("ok"))
    return tracks.mouth_audio(_mouths(spark, d), audio)


# --- windows at two rates -----------------------------------------------------------------------------------------
LEAST = 50


def lip_windows(spark: SparkSession, d: str) -> DataFrame:
    return lips.lip_windows(event_frames(spark, d), event_videos(spark, d), event_audio(spark, d), LEAST, count=40)


def lip_inputs(spark: SparkSession, d: str) -> DataFrame:
    return lips.lip_inputs(lip_windows(spark, d), event_frames(spark, d), event_videos(spark, d), event_audio(spark, d), LEAST)


def audio_under_video(spark: SparkSession, d: str) -> DataFrame:
    """Clips of 25 frames every 10 at 30000/1001 frames a second, over audio windows of 4 seconds at 16 kHz."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_frames") - 25, F.lit(0)), F.lit(10).cast("long")))
    video = event_videos(spark, d).where("n_frames >= 25").select("item_id", starts.alias("first"), F.lit(25).cast("long").alias("length"))
    heard = event_audio(spark, d).select("item_id", "samples", F.explode(frames.segment_starts(F.col("samples"), 64_600, 16_000)).alias("start"))
    audio = heard.select("item_id", "start", F.least(F.lit(64_600).cast("long"), F.col("samples")).alias("samples"))
    return rounded(lips.audio_under_video(video, audio, (30_000, 1_001), 16_000), 9)


# --- crowded frames -----------------------------------------------------------------------------------------------
def crowd_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as boxes of some ten to sixty pixels in a frame for each of up to sixty-four parts."""
    at = lambda c, by, most: (F.col(c) * by % most).cast("double")
    x, y = at("l_orderkey", 37, 500), at("l_orderkey", 91, 400)
    rows = t.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 64).alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), F.round(F.col("l_extendedprice").cast("double") % 997, 2).alias("score"),
        x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_quantity").cast("double")).alias("x2"), (y + 10 + F.col("l_quantity").cast("double") % 23).alias("y2"),
    )
    # a key that repeats is one box
    return rows.groupBy("frame", "idx").agg(F.max(F.struct("score", "x1", "y1", "x2", "y2")).alias("b")).select("frame", "idx", "b.*")


def crowd_suppress(spark: SparkSession, d: str) -> DataFrame:
    return crowd.suppress(crowd_boxes(spark, d), 0.3, batch=1_000)


# --- SQL ----------------------------------------------------------------------------------------------------------
_LINES = """select case when l_suppkey % 3 = 0 then 'track/all' else concat('track/', cast(l_suppkey % 50 as varchar)) end as item_id,
    l_orderkey * 8 + l_linenumber as frame_index, case when l_quantity >= 30 then cast(l_extendedprice as double) end as box from lineitem"""
_EVENTS = """select case when event_id // 400 % 3 = 0 then 'clip/all' else concat('clip/', cast(event_id // 400 as varchar)) end as item_id,
    case when event_id // 400 % 3 = 0 then event_id // 1200 * 400 + event_id % 400 else event_id % 400 end as frame_index,
    case when value > 20 then cast(value as double) end as box from events where event_type <> 'purchase'"""
_VIDEOS = "select item_id, max(frame_index) + 1 as n_frames from ev group by item_id"
_AUDIO = f"""select item_id, cast(greatest(case when n % 5 = 1 then 900 else n_frames * 640 - n % 3000 end, 0) as bigint) as samples
    from (select *, {crc_sql("item_id")} as n from videos) where n % 7 <> 3"""
_ITEMS = f"select unnest([item_id, concat(item_id, '-lost')]) as item_id from videos where {crc_sql('item_id')} % 5 <> 0"
_BASE = {"ev": _EVENTS, "videos": _VIDEOS, "audio": _AUDIO, "items": _ITEMS}


def _near(rows: str) -> dict[str, str]:
    """placed, then the nearest find of each row by place."""
    return {
        "placed": f"select *, row_number() over (partition by item_id order by frame_index, box nulls first) - 1 as place, count(*) over (partition by item_id) as size from ({rows})",
        "sides": """select *, last_value(case when box is not null then struct_pack(p := place, v := box) end ignore nulls) over (w rows between unbounded preceding and current row) as b,
            first_value(case when box is not null then struct_pack(p := place, v := box) end ignore nulls) over (w rows between current row and unbounded following) as a
            from placed window w as (partition by item_id order by place)""",
        "nearest": "select item_id, frame_index, place, size, case when a is null or place - b.p <= a.p - place then b.v else a.v end as filled from sides where a is not null or b is not null",
        "forward": "select item_id, frame_index, place, size, coalesce(b.v, a.v) as filled from sides",
    }


def _mean(rows: str, width: int, short: bool = False) -> str:
    """Means over the next rows, the tail keeping the last full one."""
    full = f"place + {width} <= size" + (f" or (size < {width} and place = 0)" if short else "")
    return f"""select item_id, frame_index, place, filled, last_value(m ignore nulls) over (partition by item_id order by place rows between unbounded preceding and current row) as mean
        from (select *, case when {full} then avg(filled) over (partition by item_id order by place rows between current row and {width - 1} following) end as m from {rows})"""


_MOUTHS = {
    **_BASE,
    "mouths": """select i.item_id, count(e.item_id) as n_frames, count(box) as faced, case when count(box) < 25 then 'no_face' when count(e.item_id) < 12 then 'too_short' else 'ok' end as status
        from items i left join ev e using (item_id) group by i.item_id""",
}
_LIPS = {
    **_BASE,
    "faced": f"select item_id from ev group by item_id having count(box) >= {LEAST}",
    "starts": """select item_id, n_frames, nth, (1 + samples // 512)::double / n_frames as scale,
            cast(trunc(case when nth = 39 then n_frames::double - 6 else nth * ((n_frames::double - 6) / 39) end) as bigint) as first
        from (select *, unnest(range(40)) as nth from videos join audio using (item_id) where item_id in (from faced))""",
    "cut": "select item_id, cast(nth as integer) as nth, first, cast(round_even(first * scale, 0) as bigint) as \"begin\", cast(round_even((first + 5) * scale, 0) as bigint) as \"end\" from starts where first >= 0",
    "lip": """select c.item_id, c.nth, c.first, c."begin", c."end" from cut c join ev e on e.item_id = c.item_id and e.frame_index in (c.first, c.first + 1, c.first + 2, c.first + 3, c.first + 4)
        where c."end" > c."begin" group by all having count(*) = 5""",
}

_CROWD = {
    "b": """select l_partkey % 64 as frame, l_orderkey * 8 + l_linenumber as idx, max({'score': round(cast(l_extendedprice as double) % 997, 2), 'x1': (l_orderkey * 37 % 500)::double, 'y1': (l_orderkey * 91 % 400)::double,
        'x2': l_orderkey * 37 % 500 + 10 + l_quantity::double, 'y2': l_orderkey * 91 % 400 + 10 + l_quantity::double % 23}) as box from lineitem group by all""",
    "ordered": "select frame, list({'idx': idx, 'x1': box.x1, 'y1': box.y1, 'x2': box.x2, 'y2': box.y2} order by box.score desc, idx desc) as boxes from b group by frame",
    "walked": """select frame, list_reduce(list_prepend([boxes[1]], list_transform(boxes[2:], lambda x: [x])), lambda kept, n: case when list_any_value(list_filter(kept, lambda o:
        greatest(least(o.x2, n[1].x2) - greatest(o.x1, n[1].x1) + 1, 0) * greatest(least(o.y2, n[1].y2) - greatest(o.y1, n[1].y1) + 1, 0)
        > 0.3 * ((o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1) + (n[1].x2 - n[1].x1 + 1) * (n[1].y2 - n[1].y1 + 1)
        - greatest(least(o.x2, n[1].x2) - greatest(o.x1, n[1].x1) + 1, 0) * greatest(least(o.y2, n[1].y2) - greatest(o.y1, n[1].y1) + 1, 0)))) is not null then kept else list_concat(kept, n) end) as kept from ordered""",
}

QUERIES: dict[str, tuple[Query, str | None]] = {
    "track_fill_nearest": (track_fill_nearest, with_views("select item_id, frame_index, filled, place from nearest", **_near(_LINES))),
    "track_forward_fill": (track_forward_fill, with_views("select item_id, frame_index, filled, place from forward", **_near(_LINES))),
    "track_median": (
        track_median,
        with_views(
            """select a.item_id, a.frame_index, a.place, median(b.filled) as smooth from (select *, unnest(range(-6, 7)) as o from nearest) a
                join nearest b on b.item_id = a.item_id and b.place = least(greatest(a.place + o, 0), a.size - 1) group by all""",
            **_near(_LINES),
        ),
    ),
    "track_mean": (track_mean, with_views("select item_id, frame_index, place, round(mean, 6) as mean from means where mean is not null", **_near(_LINES), means=_mean("forward", 12))),
    "track_remap": (
        track_remap,
        with_views(
            """select item_id, step, got as frame from (select *, first_value(fr ignore nulls) over (partition by item_id order by pos, kind rows between current row and unbounded following) as got
                from u) where kind = 0""",
            ev=_EVENTS,
            s="""select item_id, step, cast(floor(step::double / 25 * 24) as bigint) as pos, top from (select item_id, max(frame_index) as top,
                unnest(range(cast(ceil((max(frame_index) + 1) / 24.0::double * 25) as bigint) + 1)) as step from ev group by item_id)""",
            u="select item_id, step, pos, 0 as kind, null::bigint as fr from s where pos <= top union all select item_id, null, frame_index, 1, frame_index from ev",
        ),
    ),
    "mouth_inputs": (mouth_inputs, with_views("select * from mouths", **_MOUTHS)),
    "mouth_frames": (
        mouth_frames,
        with_views("select item_id, frame_index, round(filled, 6) as mark, round(mean, 6) as smooth from means", **_MOUTHS, **_near("select * from ev where item_id in (select item_id from mouths where status = 'ok')"), means=_mean("forward", 12)),
    ),
    "talking_frames": (
        talking_frames,
        with_views(
            "select item_id, frame_index, round(filled, 6) as mark, round(mean, 6) as smooth from means",
            "conv_frames",
            **_near("select * from conv_frames where item_id in (select item_id from conv_frames group by item_id having count(box) >= 2)"),
            means=_mean("forward", 4, short=True),
        ),
    ),
    "mouth_audio": (
        mouth_audio,
        with_views(
            "select item_id, case when s = 'ok' then n_frames end as n_frames, case when s = 'ok' then samples end as samples, s as status from heard",
            **_MOUTHS,
            heard="select m.*, samples, case when status <> 'ok' then status when samples is null then 'no_audio' when samples < 1000 then 'too_short' else 'ok' end as s from mouths m left join audio using (item_id)",
        ),
    ),
    "crowd_suppress": (crowd_suppress, with_views("select frame, unnest(list_transform(kept, lambda x: x.idx)) as idx from walked", **_CROWD)),
    "lip_windows": (lip_windows, with_views("select * from lip", **_LIPS)),
    "lip_inputs": (
        lip_inputs,
        with_views(
            f"""select v.item_id, coalesce(n, 0) as n_windows, case when n_frames <= 0 then 'unreadable' when coalesce(f, 0) < {LEAST} then 'no_face' when samples is null then 'no_audio' when n is null then 'too_short' else 'ok' end as status
                from videos v left join audio using (item_id) left join (select item_id, count(box) as f from ev group by item_id) using (item_id) left join (select item_id, count(*) as n from lip group by item_id) using (item_id)""",
            **_LIPS,
        ),
    ),
    "audio_under_video": (
        audio_under_video,
        with_views(
            """select item_id, first, cast(25 as bigint) as length, start, w as samples,
                round((least((first + 25) * 16016000, (start + w) * 30000) - greatest(first * 16016000, start * 30000)) / 480000000::double, 9) as shared_s
                from vid join aud using (item_id) where first * 16016000 < (start + w) * 30000 and start * 30000 < (first + 25) * 16016000""",
            **_BASE,
            vid="select item_id, unnest(range(0, n_frames - 24, 10)) as first from videos where n_frames >= 25",
            aud="""select item_id, least(64600, samples) as w, unnest(case when samples <= 64600 then [0::bigint] else list_concat(list_transform(range(samples // 64600), lambda i: i * 64600),
                case when samples % 64600 > 0 then [samples - 64600] else [] end) end) as start from audio where samples >= 16000""",
        ),
    ),
}
