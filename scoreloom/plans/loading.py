"""Queries over scorers' inputs, sampler statistics and row-group samples; each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import frames, loading, scoring, telemetry
from ..operators.settle import shared
from ..sources import tables as t
from ..sources.cache import DetectionCache
from ..sources.parts import PartLog
from ..sources.tables import crc_sql, with_views
from ..streaming import telemetry as streaming
from .detection import Query, rounded


def _modality(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as items; every fourth is an image."""
    ids = t.table(spark, d, "conversations").select("conv_id").distinct()
    return ids.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("item_id"), F.when(F.col("conv_id") % 4 == 0, "image").otherwise("video").alias("modality"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return loading.face_inputs(t.conv_frames(spark, d), _modality(spark, d), video=2)


def face_loading(spark: SparkSession, d: str) -> DataFrame:
    return _faces(spark, d)


def audio_video(spark: SparkSession, d: str) -> DataFrame:
    """Items with faces, and an audio track where a user speaks: as many samples as characters, too few being too_short."""
    conv = t.table(spark, d, "conversations").withColumn("item_id", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")))
    n = F.sum(F.length("text")).cast("long")
    audio = conv.where("role = 'user'").groupBy("item_id").agg(n.alias("samples")).withColumn("audio_status", F.when(F.col("samples") < 200, "too_short").otherwise("ok"))
    videos = conv.groupBy("item_id").agg((F.max("turn") + 1).alias("n_frames"), F.lit(24.0).alias("fps"))
    return loading.audio_video(_faces(spark, d), audio, videos, 25.0)


def whole_windows(spark: SparkSession, d: str) -> DataFrame:
    return loading.whole_windows(frames.forward_fill(t.conv_frames(spark, d)).select("item_id", "frame_index", F.col("filled").alias("box")), 3, 2)


def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as row groups: a nation's folder, an order's shard."""
    orders = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    groups = lines.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("shard"), F.col("l_linenumber").alias("row_group"))
    return loading.chosen_row_groups(groups, 2)


def first_items(spark: SparkSession, d: str) -> DataFrame:
    return loading.first_items(t.order_items(spark, d).select("item_id", "label"), 25)


def divergence_score(spark: SparkSession, d: str) -> DataFrame:
    """Vectors' first sixteen components as two windows of four targets and four logits each."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    part = lambda at: F.slice(e, at, 4)
    score = loading.divergence_score(F.array(part(1), part(5)), F.array(part(9), part(13)))
    return t.table(spark, d, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


def sampler_stats(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry samples of users; even ones have an energy counter: the nearest millisecond, as SQL's epoch_ms gives it."""
    s = t.event_samples(spark, d).withColumns({"util": F.col("watts") % 100, "used_gb": F.col("watts") / 7, "temp": F.col("watts") % 90})
    s = s.withColumn("counter_mj", F.when(F.col("session_id") % 2 == 0, F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000).cast("double")))
    return rounded(telemetry.sampler_stats(s, metered=F.col("session_id") % 2 == 0))


def score_log(spark: SparkSession, d: str) -> DataFrame:
    """Scores appended by two writers, of which the second has some of the first one's items again, then read and compacted."""
    scores = scoring.score_parts(t.order_windows(spark, d))
    log = PartLog(spark, f"{shared(spark)}/scores-{uuid.uuid4().hex}")
    log.append(scores.where(F.crc32("item_id") % 3 != 0))
    log.append(scores.where(F.crc32("item_id") % 3 != 1).withColumn("load_s", F.lit(-1.0)))
    before = log.version()
    log.compact()
    return rounded(log.read(before).withColumn("late", F.col("load_s") < 0).select("item_id", "score", "n_windows", "status", "late"), 9)


def cache_resume(spark: SparkSession, d: str) -> DataFrame:
    """Detections of items that a first run left, found on restart, and flushed; what the cache then has of each item."""
    found = t.conv_frames(spark, d)
    tag = uuid.uuid4().hex
    cache = DetectionCache(spark, f"detections_{tag}", f"{shared(spark)}/detections-{tag}", "item_id string, frame_index long, box double, run int", {"detector": "lengths", "size": 96})
    cache.flush(found.where(F.crc32("item_id") % 4 != 0).withColumn("run", F.lit(1)))
    left = cache.todo(found.select("item_id").distinct())
    cache.flush(found.join(left, "item_id", "left_semi").withColumn("run", F.lit(2)))
    return cache.load().groupBy("item_id", "run").agg(F.count("*").alias("frames"), F.count("box").alias("faced"))


def running_energy(spark: SparkSession, d: str) -> DataFrame:
    """Users' samples as a stream that is stopped and started again three times; the last update of each session."""
    samples, folder = t.event_samples(spark, d), f"{shared(spark)}/energy-{uuid.uuid4().hex}"
    samples = samples.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "watts")
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/{n}")
    for k in range(4):
        samples.where(F.crc32(F.col("event_id").cast("string").cast("binary")) % 4 == k).write.mode("append").parquet(f"{folder}/in")
        updates = streaming.running_energy(spark.readStream.schema(samples.schema).parquet(f"{folder}/in"), lateness="400 days", idle_s=10**9)
        query = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    last = spark.read.parquet(f"{folder}/out/*").groupBy("session_id").agg(F.max(F.struct("batch", "samples", "power_mean_w", "power_max_w", "energy_wh")).alias("u"))
    return rounded(last.select("session_id", "u.samples", "u.power_mean_w", "u.power_max_w", "u.energy_wh"), 4)


def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested configurations whose keys stand in no order, by the hash of their canonical form."""
    e = t.table(spark, d, "events")
    number = F.round(F.col("value").cast("double"), 2).cast("string")
    text = F.concat(F.lit('{"z": '), "props", F.lit(', "n" : "\u00e9",  "a": ['), number, F.lit(', null], "type": "'), "event_type", F.lit('"}'))
    return e.select("event_id", digests.config_hash(text).alias("config"))


_FACES_SQL = {
    "modality": "select distinct concat('conv/', cast(conv_id as varchar)) as item_id, case when conv_id % 4 = 0 then 'image' else 'video' end as modality from conversations",
    "faces": """select item_id, count(frame_index) as sampled, count(box) as faced, case when count(box) >= case when modality = 'image' then 1 else 2 end then 'ok' else 'no_face' end as status
        from modality left join conv_frames using (item_id) group by item_id, modality""",
}
_LOG = "list_transform({x}, lambda v: v - list_max({x}) - ln(list_sum(list_transform({x}, lambda u: exp(u - list_max({x}))))))"


def _divergence_sql() -> str:
    p, q = (_LOG.format(x=x) for x in ("p", "q"))
    return f"""with w as (select vec_id, k, list_transform(range(4), lambda i: embedding[cast(1 + 4 * k + i as int)]::double) as p, list_transform(range(4), lambda i: embedding[cast(9 + 4 * k + i as int)]::double) as q
            from embeddings cross join (select range as k from range(2))),
        l as (select vec_id, k, {p} as a, {q} as b from w),
        kl as (select vec_id, list_sum(list_transform(range(1, 5), lambda i: exp(a[cast(i as int)]) * (a[cast(i as int)] - b[cast(i as int)]))) as d from l)
        select vec_id, round(1 / (1 + exp(-avg(d))), 6) as score from kl group by vec_id"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "face_loading": (face_loading, with_views("select * from faces", "conv_frames", **_FACES_SQL)),
    "audio_video": (
        audio_video,
        with_views(
            """select item_id, faced, case when status = 'ok' and audio_status = 'ok' then samples end as samples, cast(ceil(n_frames / 24.0::double * 25) as bigint) as n_sampled,
            case when status <> 'ok' then status else coalesce(audio_status, 'no_audio') end as status from faces left join audio using (item_id) left join videos using (item_id)""",
            "conv_frames",
            **_FACES_SQL,
            audio="select concat('conv/', cast(conv_id as varchar)) as item_id, cast(sum(length(text)) as bigint) as samples, case when sum(length(text)) < 200 then 'too_short' else 'ok' end as audio_status from conversations where role = 'user' group by conv_id",
            videos="select concat('conv/', cast(conv_id as varchar)) as item_id, max(turn) + 1 as n_frames from conversations group by conv_id",
        ),
    ),
    "whole_windows": (
        whole_windows,
        with_views(
            "select f.item_id, cast(f.w * 2 as bigint) as first from f join filled g on f.item_id = g.item_id and g.pos between f.w * 2 and f.w * 2 + 2 group by f.item_id, f.w having count(distinct g.pos) = 3",
            "conv_frames",
            filled="select item_id, frame_index as pos from (select *, max(box) over (partition by item_id) as filled from conv_frames) where filled is not null",
            f="select distinct item_id, unnest(range(0, cast(pos // 2 as bigint) + 1)) as w from filled",
        ),
    ),
    "shard_rows": (
        shard_rows,
        with_views(
            """select folder, shard, row_group from (select *, row_number() over (partition by folder order by sha1(concat('0:', shard)), shard) as place
                from (select folder, shard, row_group from g qualify row_number() over (partition by folder, shard order by sha1(concat('0:', shard, '#', cast(row_group as varchar))), row_group) = 1)) where place <= 2""",
            g="select concat('n', cast(c_nationkey as varchar)) as folder, concat('s', cast(l_orderkey as varchar)) as shard, l_linenumber as row_group from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey",
        ),
    ),
    "score_log": (
        score_log,
        with_views(
            """select item_id, score, n_windows, status, crc % 3 = 0 as late from c""",
            "order_scores",
            c=f"select *, {crc_sql('item_id')} as crc from order_scores",
        ),
    ),
    "cache_resume": (
        cache_resume,
        with_views(
            f"select item_id, cast(case when {crc_sql('item_id')} % 4 <> 0 then 1 else 2 end as integer) as run, count(*) as frames, count(box) as faced from conv_frames group by item_id",
            "conv_frames",
        ),
    ),
    "running_energy": (
        running_energy,
        with_views(
            """select session_id, count(*) as samples, round(avg(watts), 4) as power_mean_w, round(max(watts), 4) as power_max_w, round(coalesce(sum(area), 0) / 3600, 4) as energy_wh
                from (select *, (sec - lag(sec) over w) * (watts + lag(watts) over w) / 2 as area from (select *, epoch_us(ts::timestamp) / 1e6 as sec from event_samples) window w as (partition by session_id order by ts, event_id))
                where session_id is not null and ts is not null and watts is not null group by session_id""",
            "event_samples",
        ),
    ),
    "config_hashes": (
        config_hashes,
        """select event_id, sha256(concat('{"a":[', cast(round(value, 2) as varchar), ',null],"n":"', chr(92), 'u00e9","type":"', event_type, '","z":{"k":', cast(props->>'k' as varchar), '}}')) as config from events""",
    ),
    "first_items": (first_items, with_views("select item_id, label from order_items order by item_id limit 25", "order_items")),
    "divergence_score": (divergence_score, _divergence_sql()),
    "sampler_stats": (
        sampler_stats,
        with_views(
            """select session_id, count(*) as samples, round_even(avg(util), 1) as gpu_util_mean, round_even(quantile_cont(util, 0.95), 1) as gpu_util_p95, round_even(max(used_gb), 3) as gpu_mem_used_max_gb,
                round_even(avg(watts), 1) as power_mean_w, round_even(max(watts), 1) as power_max_w, round_even(max(temp), 1) as temp_max_c,
                round_even(case when session_id % 2 = 0 then (max(ms) - min(ms)) / 3600000.0::double else coalesce(sum(area), 0) / 3600 end, 3) as energy_wh,
                case when session_id % 2 = 0 then 'counter' else 'integrated' end as energy_source from areas group by session_id""",
            "event_samples",
            s="select *, watts % 100 as util, watts / 7 as used_gb, watts % 90 as temp, epoch_us(ts::timestamp) / 1e6 as sec, epoch_ms(ts::timestamp) as ms from event_samples",
            areas="select *, (sec - lag(sec) over w) * (watts + lag(watts) over w) / 2 as area from s window w as (partition by session_id order by ts, event_id)",
        ),
    ),
}
