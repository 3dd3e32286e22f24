"""Queries over frames, telemetry and run tables; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalogue, frames, lineage, status, telemetry
from ..sources import tables as t
from ..sources.tables import with_views
from . import registry
from .assembly import ACCEPT_SQL, CLOSURE_SQL, VERDICT_SQL, _closure, _reg
from .detection import Query, rounded


# --- frames -------------------------------------------------------------------------------------------------------
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return frames.fill_nearest(t.conv_frames(spark, d))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return frames.forward_fill(t.conv_frames(spark, d))


def median_smooth(spark: SparkSession, d: str) -> DataFrame:
    return frames.median_smooth(frames.fill_nearest(t.conv_frames(spark, d)), "filled")


def sliding_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.sliding_mean(frames.fill_nearest(t.conv_frames(spark, d)), "filled", 3))


def frame_groups(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_groups(t.conv_frames(spark, d), 2)


def _length(spark: SparkSession, d: str) -> DataFrame:
    return t.doc_items(spark, d).select("item_id", F.col("n_chars").cast("int").alias("n"))


def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    # lengths are small and their windows many, so they are dealt to tasks before they are cut
    rows = _length(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "item_id")
    clips = rows.select("item_id", "n", F.posexplode(frames.clip_starts(F.col("n"), 25, 5)).alias("clip", "start"))
    return clips.select("item_id", "clip", F.array_join(frames.clip_at(F.col("n"), F.col("start"), 25), ",").alias("indices"))


def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _length(spark, d).select("item_id", F.explode(frames.segment_starts(F.col("n").cast("long") * 100, 64600, 16000)).alias("start"))
    return rows


def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    return _length(spark, d).select("item_id", F.array_join(frames.spread_frames(F.col("n"), 32), ",").alias("indices"))


def frame_rate_sampling(spark: SparkSession, d: str) -> DataFrame:
    return _length(spark, d).select("item_id", F.array_join(frames.rate_frames(F.col("n"), 30.0, 4.0, 60), ",").alias("indices"))


def window_sampling(spark: SparkSession, d: str) -> DataFrame:
    return _length(spark, d).select("item_id", F.array_join(frames.window_frames(F.col("n"), 10, 5), ",").alias("indices"))


def rate_remap(spark: SparkSession, d: str) -> DataFrame:
    return frames.rate_remap(t.conv_frames(spark, d), 24.0, 25.0)


def largest_face(spark: SparkSession, d: str) -> DataFrame:
    return frames.largest_box(t.conv_frames(spark, d), "box")


def face_counts(spark: SparkSession, d: str) -> DataFrame:
    return t.conv_frames(spark, d).groupBy("item_id").agg(F.count("*").alias("frames"), F.count("box").alias("faced"))


def nms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made of vectors' first components, eight a frame, suppressed within their frame."""
    e = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 100)
    rows = t.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("frame"), "vec_id", e.alias("e"))
    x, y = F.col("e")[0], F.col("e")[1]
    corner = (x.alias("x1"), y.alias("y1"), (x + 20 + F.abs(F.col("e")[2])).alias("x2"), (y + 20 + F.abs(F.col("e")[3])).alias("y2"))
    box = F.struct(F.col("e")[4].alias("score"), F.col("vec_id").alias("idx"), *corner)
    boxes = rows.groupBy("frame").agg(F.collect_list(box).alias("boxes"))
    return boxes.select("frame", F.explode(frames.nms(F.col("boxes"), 0.1)).alias("kept"))


def score_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Output formulas of scorers over vectors taken as logits."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.table(spark, d, "embeddings").withColumn("e", e)
    return rounded(
        rows.select(
            "vec_id",
            scalar.softmax_first(F.col("e")[0], F.col("e")[1]).alias("softmax"),
            scalar.mean_sigmoid(F.slice("e", 1, 7)).alias("ensemble"),
            scalar.sigmoid_logsumexp(F.col("e")).alias("logsumexp"),
            scalar.rms_db(F.col("e")).alias("rms_db"),
            scalar.iou(F.array(*(F.abs(F.col("e")[i]) + (10 if i > 1 else 0) for i in range(4))), F.array(*(F.abs(F.col("e")[i + 4]) + (10 if i > 1 else 0) for i in range(4)))).alias("iou"),
        )
    )


# --- telemetry ----------------------------------------------------------------------------------------------------
def timing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = t.order_windows(spark, d).withColumn("unit", F.col("unit_idx"))
    return telemetry.timing(rows, "load_s", ["unit"], 6)


def energy_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.energy(t.event_samples(spark, d)), 4)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    samples = t.event_samples(spark, d)
    return telemetry.sessions(samples).join(telemetry.energy(samples).select("session_id", "energy_wh"), "session_id")


def telemetry_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.roll_up(_sessions(spark, d), "click"), 3)


def phase_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.phase_totals(_sessions(spark, d)), 3)


def parity_compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(telemetry.parity(t.parity_units(spark, d), 1e-3), 9)


def profile_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_tax").cast("double") + 0.01).alias("s"), F.col("l_quantity").cast("double").alias("u"))
    return rounded(telemetry.profile(rows, "l_returnflag", "s", "u"))


# --- runs ---------------------------------------------------------------------------------------------------------
def _latest(spark: SparkSession) -> DataFrame:
    return status.latest_runs(registry.frame(spark, "reg_runs"), registry.frame(spark, "reg_hashes"))


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark).select("run_id", "model", "evalset", "auc")


def run_flags(spark: SparkSession, d: str) -> DataFrame:
    return status.run_flags(_latest(spark), registry.frame(spark, "reg_parity"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return status.provenance(registry.frame(spark, "reg_sessions"))


def _cells(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    accepts = lineage.accept_matrix(registry.frame(spark, "reg_models"), registry.frame(spark, "reg_sets"))
    verdicts = lineage.verdicts(registry.frame(spark, "reg_components"), registry.frame(spark, "reg_training"), _closure(spark))
    return accepts, status.cell_matrix(accepts, verdicts)


def cell_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark)[1]


def result_grid(spark: SparkSession, d: str) -> DataFrame:
    accepts, cells = _cells(spark)
    models = registry.frame(spark, "reg_models").select("model", (F.col("status") != "blocked").alias("adapter"))
    sets = registry.frame(spark, "reg_sets").select("evalset", (F.col("items") > 500).alias("ready"))
    return status.result_grid(accepts, cells, _latest(spark), models, sets, ["es_clips", "es_joint", "es_old", "es_voice"])


def archive_index(spark: SparkSession, d: str) -> DataFrame:
    runs = registry.frame(spark, "reg_runs")
    restricted = lineage.restricted(runs.select("run_id", "evalset"), registry.frame(spark, "reg_components").select("evalset", "dataset"), _closure(spark), ["co_web"])
    return status.archive_index(runs.select("run_id"), runs.select("run_id", "summary"), registry.frame(spark, "reg_published"), restricted)


def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    return registry.frame(spark, "reg_runs").select("run_id", status.publish_refusal(F.col("role"), F.col("evalset"), F.col("namespace")).alias("refusal"))


def model_runs(spark: SparkSession, d: str) -> DataFrame:
    """A model's runs with their place: reproductions first, then the best."""
    w = Window.partitionBy("model").orderBy(F.when(F.col("role") == "reproduction", 0).otherwise(1), F.col("auc").desc(), "run_id")
    return _latest(spark).select("model", "run_id", F.row_number().over(w).alias("place"))


def recorded_features(spark: SparkSession, d: str) -> DataFrame:
    return status.recorded(t.order_items(spark, d), ["method", "source_subject_id", "g_segment", "subject_id"], "label")


def lang_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Languages by kind of data set: held, or known only."""
    rows = registry.frame(spark, "reg_datasets").groupBy("language", "modality").agg(F.bool_or("held").alias("held"))
    return rows.select("language", "modality", F.when(F.col("held"), "held").otherwise("known").alias("state"))


def kinds_crosstab(spark: SparkSession, d: str) -> DataFrame:
    docs = t.doc_items(spark, d).groupBy("language", "label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    return docs.withColumn("methods", scalar.first_and_more(F.split("methods", ","), 3))


def auc_range(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark).groupBy("evalset").agg(F.min("auc").alias("low"), F.max("auc").alias("high"), F.count_if(F.col("auc") < 0.5).alias("below_chance"))


def auc_bin(spark: SparkSession, d: str) -> DataFrame:
    return t.doc_items(spark, d).select("item_id", scalar.auc_bin(F.col("score")).alias("bin"))


def time_estimate(spark: SparkSession, d: str) -> DataFrame:
    sets = registry.frame(spark, "reg_sets").select("evalset", "modality", "items")
    windows = F.when(F.col("items") > 10, F.col("items") * 3)
    took = telemetry.estimate_seconds(F.col("modality"), F.col("items"), windows, F.lit(4.5), F.lit(7200.0))
    return sets.select("evalset", F.round(took, 6).alias("seconds"), scalar.duration_text(took).alias("text"))


def source_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = registry.frame(spark, "reg_datasets").groupBy("modality").agg(F.map_from_entries(F.collect_set(F.struct("language", F.array(F.concat("language", F.lit("/*"))).alias("p")))).alias("by_language"))
    keyed = rows.where("modality = 'audio'").select(F.col("modality").alias("dataset"), F.array(F.lit("*.csv")).alias("base"), "by_language")
    return catalogue.listing_patterns(keyed, ["hi", "bn"])


def newest_files(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations").select(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("store"), F.col("conv_id").alias("store_rank"), F.length("text").cast("long").alias("modified"))
    return catalogue.newest_files(c)


def run_wall(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("modified"), "event_id")
    return catalogue.run_wall(e.select("run_id", "modified", (F.col("event_id") % 7).alias("n_windows")), e.select("run_id", F.col("modified").alias("started")))


def set_sizes(spark: SparkSession, d: str) -> DataFrame:
    items = t.doc_items(spark, d).select(F.col("language").alias("evalset"), "item_id")
    counted = t.doc_items(spark, d).where("method = 'src1'").select(F.col("language").alias("evalset"), F.col("item_id").alias("run_id"), F.col("n_chars").alias("windows"))
    return catalogue.set_sizes(items, counted)


def default_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = registry.frame(spark, "reg_components").groupBy("evalset", "modality").agg(F.collect_set("dataset").alias("datasets"))
    accepts = lineage.accept_matrix(registry.frame(spark, "reg_models"), registry.frame(spark, "reg_sets")).where("accepted")
    rows = accepts.join(sets, "evalset").join(registry.frame(spark, "reg_models").select("model", F.col("modality").alias("model_modality")), "model")
    return catalogue.default_sets(rows.withColumn("position", F.col("evalset")))


def smallest_archives(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.smallest_archives(t.doc_items(spark, d).select(F.col("label"), F.col("n_chars").alias("size"), F.col("item_id").alias("member")))


def published_difference(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = F.col("l_discount").cast("double") * 10, F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax").cast("double") * 10 + 0.003)
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", catalogue.published_difference(ours, theirs).alias("difference"))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    rec = F.when(F.col("held"), "full").when(F.col("language") == "bn", "sample")
    state = F.when(F.col("role") == "reproduction", "request").otherwise("open")
    rows = registry.frame(spark, "reg_datasets").select("dataset", catalogue.holding(rec, state, F.array(F.lit("hi")), F.array_distinct(F.array("language", F.lit("hi")))).alias("state"))
    return rows


def headline_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.headline(registry.frame(spark, "reg_models").select(F.col("status").alias("state")))


def licence_names(spark: SparkSession, d: str) -> DataFrame:
    return registry.frame(spark, "reg_models").select("model", catalogue.licence_name(F.col("name")).alias("short"))


def siblings(spark: SparkSession, d: str) -> DataFrame:
    return status.siblings(registry.frame(spark, "reg_models").select("model", "status", "modality"), "model", "modality").select("model", "previous", "next")


def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return status.run_lengths(t.table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", "turn", "conv_id")


def grid_columns(spark: SparkSession, d: str) -> DataFrame:
    runs = _latest(spark).groupBy("evalset").agg(F.count("*").alias("runs"))
    return status.grid_columns(registry.frame(spark, "reg_sets").join(runs, "evalset", "left").fillna({"runs": 0})).select("evalset", "place")


def short_names(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.split("name", r" \(")[0])
    return registry.frame(spark, "reg_models").select("model", scalar.shortened(F.col("name"), w).alias("shown"))


# --- SQL ----------------------------------------------------------------------------------------------------------
_PLACED = "select *, row_number() over (partition by item_id order by frame_index) - 1 as place from conv_frames"
_NEAREST = {
    "placed": _PLACED,
    "known": "select item_id, place, box from placed where box is not null",
    "nearest": "select p.item_id, p.frame_index, p.place, arg_min(k.box, struct_pack(d := abs(p.place - k.place), k := k.place)) as filled from placed p join known k using (item_id) group by all",
}
_LATEST = "select * from reg_runs where role <> 'pipeline_test' and namespace is null and (model, config_hash) in (select model, config_hash from reg_hashes) qualify row_number() over (partition by model, evalset order by started desc, source_rank, run_id) = 1"
_CELLS = {
    "accepts": ACCEPT_SQL,
    **CLOSURE_SQL,
    **VERDICT_SQL,
    "cells": "select a.model, a.evalset, case when not accepted then 'na' when verdict = 'contaminated' then 'guard' end as state from accepts a left join verdicts v using (model, evalset)",
}
_LEN = "select item_id, cast(n_chars as integer) as n from doc_items"
_ENERGY = "select session_id, count(*) as samples, avg(watts) as power_mean_w, max(watts) as power_max_w, coalesce(sum(area), 0) / 3600 as energy_wh from (select *, (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over w) * (watts + lag(watts) over w) / 2 as area from event_samples window w as (partition by session_id order by ts, event_id)) group by session_id"


def _clip_sql() -> str:
    """Indices of a padded track by reflection: position p of a track of n frames that starts ``pad`` before frame 0."""
    pad, clip = 24, 25
    return with_views(
        """select item_id, cast(clip as integer) as clip, string_agg(cast(idx as varchar), ',' order by k) as indices from (
        select item_id, s / 5 as clip, k, case when n >= 25 then s + k
            when s + k < 24 then pre[len(pre) - 24 + s + k + 1] when s + k < 24 + n then s + k - 24 else post[(s + k - 24 - n) % len(post) + 1] end as idx
        from (select *, unnest(range(0, total - 24, 5)) as s from padded) cross join (select range as k from range(25))) group by all""",
        "doc_items",
        l="select item_id, n_chars as n from doc_items",
        cyc="select item_id, n, list_concat(range(n), list_reverse(range(1, n - 1))) as pre1, list_concat(list_reverse(range(1, n - 1)), range(n)) as post from l where n >= 1",
        padded=f"""select item_id, n, post, case when n >= {clip} then n else n + {2 * pad} end as total,
            flatten([pre1 for k in range(25)]) as pre from cyc""",
    )


QUERIES: dict[str, tuple[Query, str | None]] = {
    "fill_nearest": (fill_nearest, with_views("select item_id, frame_index, filled from nearest", "conv_frames", **_NEAREST)),
    "forward_fill": (
        forward_fill,
        with_views("select item_id, frame_index, coalesce(last_value(box ignore nulls) over (partition by item_id order by frame_index rows between unbounded preceding and current row), first_value(box ignore nulls) over (partition by item_id order by frame_index rows between unbounded preceding and unbounded following)) as filled from conv_frames", "conv_frames"),
    ),
    "median_smooth": (
        median_smooth,
        with_views(
            "select item_id, frame_index, median(v) as smooth from (select a.item_id, a.frame_index, o, (select filled from nearest b where b.item_id = a.item_id and b.place = least(greatest(a.place + o, 0), m.top)) as v from nearest a join (select item_id, max(place) as top from nearest group by item_id) m using (item_id) cross join (select range - 6 as o from range(13))) group by all",
            "conv_frames",
            **_NEAREST,
        ),
    ),
    "sliding_mean": (
        sliding_mean,
        with_views(
            "select item_id, frame_index, round(last_value(m ignore nulls) over (partition by item_id order by frame_index rows between unbounded preceding and current row), 6) as mean from (select item_id, frame_index, case when count(*) over w = 3 then avg(filled) over w end as m from nearest window w as (partition by item_id order by frame_index rows between current row and 2 following)) qualify mean is not null",
            "conv_frames",
            **_NEAREST,
        ),
    ),
    "frame_groups": (frame_groups, with_views('select item_id, cast(place // 2 as bigint) as "group", min(frame_index) as first, max(frame_index) as last, count(*) as n from placed group by all having count(*) = 2', "conv_frames", placed=_PLACED)),
    "clip_windows": (clip_windows, _clip_sql()),
    "segment_windows": (
        segment_windows,
        with_views(
            "select item_id, unnest(case when s <= 64600 then [0::bigint] else list_concat(list_transform(range(s // 64600), lambda i: i * 64600), case when s % 64600 > 0 then [s - 64600] else [] end) end) as start from l where s >= 16000",
            "doc_items",
            l="select item_id, cast(n_chars as bigint) * 100 as s from doc_items",
        ),
    ),
    "frame_sampling": (
        frame_sampling,
        with_views("select item_id, array_to_string(case when n <= 32 then range(n) else list_transform(range(32), lambda i: cast(round_even(i * (n - 1)::double / 31, 0) as bigint)) end, ',') as indices from l", "doc_items", l=_LEN),
    ),
    "frame_rate_sampling": (
        frame_rate_sampling,
        with_views("select item_id, coalesce(array_to_string(list_slice(list_sort(list_distinct(list_transform(range(cast(ceil(n::double / 30 * 4) as bigint)), lambda i: least(cast(floor(i::double / 4 * 30) as bigint), n - 1)))), 1, 60), ','), '') as indices from l", "doc_items", l="select item_id, n_chars as n from doc_items"),
    ),
    "window_sampling": (
        window_sampling,
        with_views("select item_id, case when n > 5 then array_to_string(list_sort(list_distinct(flatten(list_transform(range(10), lambda i: list_transform(range(5), lambda k: cast(floor(i::double * ((n::double - 6) / 9)) as bigint) + k))))), ',') else '' end as indices from l", "doc_items", l="select item_id, n_chars as n from doc_items"),
    ),
    "rate_remap": (
        rate_remap,
        with_views(
            "select s.item_id, s.step, min(f.frame_index) as frame from s join conv_frames f on f.item_id = s.item_id and f.frame_index >= s.wanted group by all",
            "conv_frames",
            s="select item_id, step, cast(floor(step::double / 25 * 24) as bigint) as wanted from (select item_id, max(frame_index) as top, unnest(range(cast(ceil((max(frame_index) + 1) / 24.0::double * 25) as bigint) + 1)) as step from conv_frames group by item_id) where floor(step::double / 25 * 24) <= top",
        ),
    ),
    "largest_face": (largest_face, with_views("select item_id, frame_index, box from conv_frames qualify row_number() over (partition by item_id order by box desc nulls last, frame_index) = 1", "conv_frames")),
    "face_counts": (face_counts, with_views("select item_id, count(*) as frames, count(box) as faced from conv_frames group by item_id", "conv_frames")),
    "nms": (
        nms,
        with_views(
            "select frame, unnest(list_transform(kept, lambda x: x.idx)) as kept from walk where k = n",
            e="select vec_id // 8 as frame, vec_id, list_transform(embedding[1:5], lambda x: x::double * 100) as e from embeddings",
            box="select frame, {score: e[5], idx: vec_id, x1: e[1], y1: e[2], x2: e[1] + 20 + abs(e[3]), y2: e[2] + 20 + abs(e[4])} as b from e",
            ranked="select frame, b, row_number() over (partition by frame order by b.score desc, b.idx desc) as k, count(*) over (partition by frame) as n from box",
            walk="""select frame, k, n, [b] as kept from ranked where k = 1 union all
                select r.frame, r.k, r.n, case when len(list_filter(kept, lambda o: greatest(least(o.x2, r.b.x2) - greatest(o.x1, r.b.x1) + 1, 0) * greatest(least(o.y2, r.b.y2) - greatest(o.y1, r.b.y1) + 1, 0)
                    / ((o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1) + (r.b.x2 - r.b.x1 + 1) * (r.b.y2 - r.b.y1 + 1)
                    - greatest(least(o.x2, r.b.x2) - greatest(o.x1, r.b.x1) + 1, 0) * greatest(least(o.y2, r.b.y2) - greatest(o.y1, r.b.y1) + 1, 0)) > 0.1)) > 0
                    then kept else list_append(kept, r.b) end from walk w join ranked r on w.frame = r.frame and r.k = w.k + 1""",
        ),
    ),
    "score_formulas": (
        score_formulas,
        """select vec_id, round(1 / (1 + exp(e[2] - e[1])), 6) softmax, round(list_avg(list_transform(e[1:7], lambda x: 1 / (1 + exp(-x)))), 6) ensemble, round(1 / (1 + 1 / list_sum(list_transform(e, lambda x: exp(-x)))), 6) logsumexp,
        round(greatest(20 * log10(sqrt(list_avg(list_transform(e, lambda x: x * x)))), -120), 6) rms_db, round(inter / (aa + ab - inter), 6) iou from (
        select *, greatest(least(a3, b3) - greatest(a1, b1) + 1, 0) * greatest(least(a4, b4) - greatest(a2, b2) + 1, 0) as inter, (a3 - a1 + 1) * (a4 - a2 + 1) as aa, (b3 - b1 + 1) * (b4 - b2 + 1) as ab from (
        select vec_id, e, abs(e[1]) a1, abs(e[2]) a2, abs(e[3]) + 10 a3, abs(e[4]) + 10 a4, abs(e[5]) b1, abs(e[6]) b2, abs(e[7]) + 10 b3, abs(e[8]) + 10 b4 from (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)))""",
    ),
    "timing_percentiles": (timing_percentiles, with_views("select unit_idx as unit, round(avg(load_s * 1000), 6) as mean, round(quantile_cont(load_s * 1000, 0.5), 6) as p50, round(quantile_cont(load_s * 1000, 0.95), 6) as p95 from order_windows group by unit_idx", "order_windows")),
    "telemetry_rollup": (
        telemetry_rollup,
        with_views(
            """select count(*) as sessions, count(*) filter (completed) as sessions_completed, round(sum(wall_s), 3) as wall_s, cast(sum(items) as bigint) as items, round(sum(score_s), 3) as score_s, round(sum(items) / nullif(sum(score_s), 0), 3) as items_per_s,
            round(sum(mean_w * items) / sum(items), 3) as mean_w, round(max(peak), 3) as peak, round(sum(energy_wh), 3) as energy_wh, round(sum(energy_wh) / sum(items) * 1000, 3) as energy_wh_per_1k_items from s join en using (session_id)""",
            "event_samples",
            en=_ENERGY,
            s="select session_id, count(*) as items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as wall_s, bool_or(phase = 'purchase') as completed, max(watts) as peak, avg(watts) as mean_w, coalesce(sum(watts) filter (phase = 'click'), 0) as score_s from event_samples group by session_id",
        ),
    ),
    "phase_totals": (phase_totals, with_views("select phase, round(sum(watts), 3) as seconds from event_samples group by phase", "event_samples")),
    "energy_trapezoid": (energy_trapezoid, with_views("select session_id, samples, round(power_mean_w, 4) power_mean_w, round(power_max_w, 4) power_max_w, round(energy_wh, 4) energy_wh from en", "event_samples", en=_ENERGY)),
    "parity_compare": (parity_compare, with_views("select count(*) as n, round(max(abs(adapter - reference)), 9) as max_diff, round(avg(abs(adapter - reference)), 9) as mean_diff, count(*) > 0 and max(abs(adapter - reference)) <= 1e-3 as passed from parity_units", "parity_units")),
    "profile_medians": (profile_medians, "select l_returnflag, round(median(s * 1000), 6) as median_ms, round(median(s * 1000 / u), 6) as median_ms_per_unit, round(avg(u), 6) as mean_units from (select l_returnflag, cast(l_tax as double) + 0.01 as s, cast(l_quantity as double) as u from lineitem) group by l_returnflag"),
    "latest_runs": (latest_runs, _reg("select run_id, model, evalset, auc from latest", latest=_LATEST)),
    "run_flags": (
        run_flags,
        _reg(
            """select run_id, concat_ws('; ', case when verdict <> 'clean' then replace(verdict, '_', ' ') end, case when pairing = 'cross_corpus' then 'cross-corpus' end,
            case when model not in (select model from reg_parity where passed) then 'no parity check' end, case when model not in (select model from latest where role = 'reproduction' and auc > 0.5) then 'score direction unchecked' end,
            case when auc < 0.5 then 'below chance' end, case when unscored_items > 0 then cast(unscored_items as varchar) || ' unscored' end) as flags from latest""",
            latest=_LATEST,
        ),
    ),
    "provenance": (provenance, _reg("select run_id, min(started) as first_started, max(started) as last_started, coalesce(string_agg(distinct device, ',' order by device), '') as devices, coalesce(bool_or(dirty), false) as dirty, count(*) as sessions from reg_sessions group by run_id")),
    "cell_matrix": (cell_matrix, _reg("select * from cells where state is not null", **_CELLS)),
    "result_grid": (
        result_grid,
        _reg(
            "select model, max(kind) filter (evalset = 'es_clips') es_clips, max(kind) filter (evalset = 'es_joint') es_joint, max(kind) filter (evalset = 'es_old') es_old, max(kind) filter (evalset = 'es_voice') es_voice from (select model, evalset, case when run_id is not null then 'run' when state = 'guard' then 'trained' when state = 'na' then 'na' when m.status = 'blocked' then 'off' when e.items <= 500 then 'pending' else 'todo' end as kind from cells left join latest using (model, evalset) join reg_models m using (model) join reg_sets e using (evalset)) group by model",
            **_CELLS,
            latest=_LATEST,
        ),
    ),
    "archive_index": (
        archive_index,
        _reg(
            """select run_id, summary->>'$.model' as model, cast(summary->>'$.overall.n' as bigint) as n, cast(summary->>'$.overall.auc' as double) as auc, summary->>'$.compute.env.gpu' as gpu, run_id in (select run_id from reg_published) as published
            from reg_runs where evalset in (select evalset from reg_components) and evalset not in (select evalset from reg_components c join closure on closure.source = c.dataset where node = 'co_web')""",
            **CLOSURE_SQL,
        ),
    ),
    "publish_gate": (publish_gate, _reg("select run_id, case when role = 'pipeline_test' then evalset || ' is a pipeline test' when namespace is not null then 'namespace ' || namespace || ' holds pipeline tests' end as refusal from reg_runs")),
    "model_runs": (model_runs, _reg("select model, run_id, cast(row_number() over (partition by model order by case when role = 'reproduction' then 0 else 1 end, auc desc, run_id) as integer) as place from latest", latest=_LATEST)),
    "recorded_features": (
        recorded_features,
        with_views("select label, feature from (select label, unnest(['method', 'source_subject_id', 'g_segment', 'subject_id']) as feature, unnest([count(method), count(source_subject_id), count(g_segment), count(subject_id)]) as n from order_items group by label) where n > 0", "order_items"),
    ),
    "lang_matrix": (lang_matrix, _reg("select language, modality, case when bool_or(held) then 'held' else 'known' end as state from reg_datasets group by all")),
    "kinds_crosstab": (
        kinds_crosstab,
        with_views("select language, label, n, case when len(m) > 3 then array_to_string(m[1:3], ', ') || ' and ' || cast(len(m) - 3 as varchar) || ' more' else array_to_string(m, ', ') end as methods from (select language, label, count(*) as n, list_sort(list(distinct method)) as m from doc_items group by all)", "doc_items"),
    ),
    "auc_range": (auc_range, _reg("select evalset, min(auc) as low, max(auc) as high, count(*) filter (auc < 0.5) as below_chance from latest group by evalset", latest=_LATEST)),
    "auc_bin": (auc_bin, with_views("select item_id, case when score is null then null else (case when f < 0.2 then 0 when f < 0.5 then 1 when f < 0.8 then 2 when f < 0.94 then 3 else 4 end) * (case when score < 0.5 then -1 else 1 end) end as bin from (select *, abs(2 * score - 1) as f from doc_items)", "doc_items")),
    "time_estimate": (
        time_estimate,
        _reg("select evalset, round(s, 6) as seconds, case when n >= 3600 then printf('%d h %02d m', n // 3600, n % 3600 // 60) when n >= 60 then printf('%d m %02d s', n // 60, n % 60) when n is not null then printf('%d s', n) end as text from (select evalset, s, cast(floor(s) as bigint) as n from (select evalset, case when modality = 'audio' then case when items > 10 then items * 3 * cast(4.5 as double) / 1000 end else items * cast(7200 as double) / 1000 end as s from reg_sets))"),
    ),
    "source_patterns": (source_patterns, "select 'audio' as dataset, unnest(['*.csv', 'hi/*', 'bn/*']) as pattern"),
    "newest_files": (newest_files, "select concat('f', cast(turn as varchar)) as path, concat('s', cast(arg_max(conv_id, struct_pack(m := length(text), r := -conv_id)) as varchar)) as store, max(length(text)) as modified from conversations group by turn"),
    "run_wall": (run_wall, "select user_id as run_id, cast(max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) as bigint) as wall_s, cast(sum(event_id % 7) as bigint) as windows from events group by user_id"),
    "set_sizes": (set_sizes, with_views("select language as evalset, count(*) as items, arg_min(n_chars, item_id) filter (method = 'src1' and n_chars > 0) as windows from doc_items group by language", "doc_items")),
    "default_sets": (
        default_sets,
        _reg(
            "select model, evalset from (select a.model, a.evalset, row_number() over (partition by a.model, s.data order by case when s.modality = m.modality then 0 else 1 end, a.evalset) as n from a join s using (evalset) join reg_models m on m.model = a.model where accepted) where n = 1",
            a=ACCEPT_SQL,
            s="select evalset, any_value(modality) as modality, list_sort(list(distinct dataset)) as data from reg_components group by evalset",
        ),
    ),
    "smallest_archives": (smallest_archives, with_views("select label, item_id as member, n_chars as size from doc_items qualify row_number() over (partition by label order by n_chars, item_id) = 1", "doc_items")),
    "published_difference": (
        published_difference,
        "select l_orderkey, l_linenumber, case when d is null then '·' else concat(case when d > 0.005 then '+' when d < -0.005 then '−' else '±' end, printf('%.2f', abs(d))) end as difference from (select *, cast(l_discount as double) * 10 - case when l_orderkey % 5 > 0 then cast(l_tax as double) * 10 + cast(0.003 as double) end as d from lineitem)",
    ),
    "holdings": (holdings, _reg("select dataset, case when held then case when language = 'hi' then 'in hand' else 'in hand: 1 of 2 languages' end when language = 'bn' then 'sample only' when role = 'reproduction' then 'on request' else 'open' end as state from reg_datasets")),
    "headline_counts": (headline_counts, _reg("select status as state, count(*) as n from reg_models group by status")),
    "licence_names": (licence_names, _reg("select model, split_part(name, ' (', 1) as short from reg_models")),
    "siblings": (siblings, _reg("select model, lag(model) over w as previous, lead(model) over w as next from reg_models window w as (partition by modality order by model)")),
    "run_lengths": (run_lengths, "select conv_id, cast(run as bigint) as run, role, count(*) as n, min(turn) as first from (select *, sum(c) over (partition by conv_id order by turn) as run from (select conv_id, turn, role, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as c from conversations)) group by all"),
    "grid_columns": (grid_columns, _reg("select evalset, cast(row_number() over (order by case when role = 'reproduction' then 1 else 0 end, case when runs > 0 then 0 else 1 end, items desc, evalset) as integer) as place from reg_sets left join (select evalset, count(*) as runs from latest group by evalset) using (evalset)", latest=_LATEST)),
    "short_names": (short_names, _reg("select model, case when count(*) over (partition by split_part(name, ' (', 1)) = 1 then split_part(name, ' (', 1) else name end as shown from reg_models")),
}
