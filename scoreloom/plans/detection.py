"""Queries over scored items: unit reduction, curves, metrics per group, bootstrap; each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, metrics, roc, scoring, shortcut
from ..sources import tables as t
from ..sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]
REPLICATES = 1000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_parts(t.order_windows(spark, d))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored_items(t.order_items(spark, d), scores(spark, d))


# --- SQL of curves ------------------------------------------------------------------------------------------------
def curve_sql(rows: str, by: str, weight: str = "1") -> dict[str, str]:
    """Common table expressions pts, cum and verts over ``rows`` (a query of by, y, s)."""
    return {
        "rows_in": rows,
        "pts": f"select {by}, s, sum(y * {weight})::double dtp, sum((1 - y) * {weight})::double dfp from rows_in group by all",
        "cum": f"select *, sum(dtp) over w tps, sum(dfp) over w fps, sum(dtp) over (partition by {by}) P, sum(dfp) over (partition by {by}) N from pts window w as (partition by {by} order by s desc)",
        "lagged": f"select *, lag(tps) over w lt, lag(fps) over w lf, lead(tps) over w nt, lead(fps) over w nf from cum window w as (partition by {by} order by s desc)",
        "verts": f"""select {by}, s as threshold, fps / nullif(N, 0) fpr, tps / nullif(P, 0) tpr from lagged
            where lt is null or nt is null or nt - 2 * tps + lt <> 0 or nf - 2 * fps + lf <> 0
            union all select {by}, null, case when N > 0 then 0 end, case when P > 0 then 0 end from lagged where lt is null""",
        "stepped": f"select *, 1 - tpr - fpr as diff, lag(1 - tpr - fpr) over w ld, lag(fpr) over w lfpr from verts window w as (partition by {by} order by threshold desc nulls first)",
        "crossing": f"select {by}, threshold, lfpr + ld / (ld - diff) * (fpr - lfpr) as eer from stepped where diff <= 0 and ld > 0",
        "areas": f"""select {by}, case when max(P) > 0 and max(N) > 0 then sum(dfp * (tps - dtp / 2)) / nullif(max(P) * max(N), 0) end as auc,
            case when max(P) > 0 and max(N) > 0 then sum(dtp / nullif(P, 0) * tps / (tps + fps)) end as ap from cum group by all""",
        "tprs": f"select {by}, max(tpr) filter (fpr <= 0.01) as t01, max(tpr) filter (fpr <= 0.05) as t05 from verts group by all",
    }


def interval_sql(rows: str, n: int = 1000) -> dict[str, str]:
    """Common table expressions up to ``ivals(grp, auc_lo, auc_hi, eer_lo, eer_hi)`` over ``rows`` (of grp, y, s, item_id)."""
    p, (a, b, c) = intervals.PRIME, intervals.STEPS
    weight = " + ".join(f"(u >= {x:.17g})::bigint" for x in intervals.POISSON)
    return {
        "i_base": f"select grp, y, s, cast(concat('0x', substr(sha1(item_id), 1, 7)) as bigint) as x0 from ({rows})",
        "i_1": f"select grp, y, s, x0, r, (x0 * {a} + r * {b} + 1) % {p} as x from i_base cross join (select range as r from range({n}))",
        "i_2": f"select grp, y, s, r, (x * x + x0) % {p} as x from i_1",
        "i_3": f"select grp, y, s, r, (x * {c} + r) % {p} as x from i_2",
        "i_4": f"select grp, y, s, r, ((x * x + 7) % {p}) / {p}::double as u from i_3",
        "i_w": f"select grp, y, s, r, {weight} as w from i_4",
        "i_pts": "select grp, r, s, sum(y * w)::double dtp, sum((1 - y) * w)::double dfp from i_w where w > 0 group by all",
        "i_cum": """select *, sum(dtp) over o tps, sum(dfp) over o fps, sum(dtp) over (partition by grp, r) P, sum(dfp) over (partition by grp, r) N
            from i_pts window o as (partition by grp, r order by s desc)""",
        "i_step": """select grp, r, fps / N fpr, 1 - tps / P - fps / N as diff, coalesce(lag(fps / N) over o, 0) lfpr, coalesce(lag(1 - tps / P - fps / N) over o, 1) ld
            from i_cum where P > 0 and N > 0 window o as (partition by grp, r order by s desc)""",
        "i_auc": "select grp, r, sum(dfp * (tps - dtp / 2)) / (max(P) * max(N)) as auc from i_cum where P > 0 and N > 0 group by all",
        "i_eer": "select grp, r, lfpr + ld / (ld - diff) * (fpr - lfpr) as eer from i_step where diff <= 0 and ld > 0",
        "ivals": """select grp, quantile_cont(auc, 0.025) auc_lo, quantile_cont(auc, 0.975) auc_hi, quantile_cont(eer, 0.025) eer_lo, quantile_cont(eer, 0.975) eer_hi
            from i_auc left join i_eer using (grp, r) group by grp""",
    }


_ENDS = "round(auc_lo, 6) auc_lo, round(auc_hi, 6) auc_hi, round(eer_lo, 6) eer_lo, round(eer_hi, 6) eer_hi"
_ROWS = "select 0 as g, case when label = 'fake' then 1 else 0 end as y, score as s from joined where status = 'ok' and score is not null"
_JOINED = "select * from order_items join order_scores using (item_id)"
_VIEWS = ("order_items", "order_scores")


def _over_joined(query: str, rows: str = _ROWS, by: str = "g", **more: str) -> str:
    return with_views(query, *_VIEWS, joined=_JOINED, **curve_sql(rows, by), **more)


# --- queries ------------------------------------------------------------------------------------------------------
def _items(how: str) -> Query:
    return lambda spark, d: scoring.item_scores(t.order_windows(spark, d), how)


def _items_sql(call: str) -> str:
    return with_views(f"select item_id, round({call}, 9) as score, cast(count(*) as bigint) as n_windows from order_windows group by item_id", "order_windows")


def _curve_rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scored_rows(joined(spark, d).withColumn("g", F.lit(0)), ["g"])


def auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roc.areas(_curve_rows(spark, d), ["g"]).select("auc"))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roc.areas(_curve_rows(spark, d), ["g"]).select("ap"))


def eer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roc.readings(roc.curve(_curve_rows(spark, d), ["g"]), ["g"]).select("eer", "threshold"))


def tpr_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roc.readings(roc.curve(_curve_rows(spark, d), ["g"]), ["g"]).select("tpr_at_fpr01", "tpr_at_fpr05"))


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(roc.curve(_curve_rows(spark, d), ["g"]).select("threshold", "fpr", "tpr"))


def rates_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.at_threshold(joined(spark, d).withColumns({"threshold": F.lit(0.5), "g": F.lit(0)}), ["g"]).select("fpr", "fnr"))


def accuracy_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.at_threshold(joined(spark, d).withColumns({"threshold": F.lit(0.5), "g": F.lit(0)}), ["g"]).select("acc", "bal_acc"))


_RATES = """avg(case when label = 'real' then (score >= thr)::int::double end) as fpr, avg(case when label = 'fake' then 1 - (score >= thr)::int::double end) as fnr,
    avg(((score >= thr) = (label = 'fake'))::int::double) as acc"""
_BAL = "1 - (coalesce(fpr, 0) + coalesce(fnr, 0)) / nullif((fpr is not null)::int + (fnr is not null)::int, 0)"


def score_join(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).select("item_id", "label", "g_segment", "score", "status", "n_windows")


def unscored_count(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unscored(t.order_items(spark, d), scores(spark, d)).agg(F.count("*").alias("unscored_items"))


def failures_by_status(spark: SparkSession, d: str) -> DataFrame:
    return scoring.failures_by_status(scores(spark, d))


def overall_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(joined(spark, d)))


def per_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Window means to item scores, joined with the items; the set's own equal-error threshold; a row for each segment."""
    return rounded(metrics.per_group(joined(spark, d), "g_segment"))


def doc_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_group(t.doc_items(spark, d), "language"))


def score_direction(spark: SparkSession, d: str) -> DataFrame:
    return metrics.direction_ok(joined(spark, d))


def bootstrap_hash(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.hash_bootstrap(joined(spark, d), REPLICATES))


def bootstrap_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.exact_bootstrap(joined(spark, d), "g_segment"))


def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each segment from 1,000 replicates."""
    return rounded(intervals.intervals(joined(spark, d), "g_segment").withColumnRenamed("grp", "g_segment"))


def metric_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of average precision and of the rates within 1 and 5 % of the reals, of each language, from 1,000 replicates."""
    wanted = {name: intervals.METRICS[name] for name in ("ap", "tpr_at_fpr01", "tpr_at_fpr05")}
    return rounded(intervals.metric_intervals(t.doc_items(spark, d), "language", wanted).withColumnRenamed("grp", "language"))


def _group_sql(source: str, group: str, *views: str, **more: str) -> str:
    ok = "status = 'ok' and score is not null"
    y = "case when label = 'fake' then 1 else 0 end as y, score as s"
    whole = {f"w_{k}": v for k, v in curve_sql(f"select 0 as g, {y} from grouped where {ok}", "g").items()}
    for k in whole:
        for name in ("rows_in", "pts", "cum", "lagged", "verts", "stepped"):
            whole[k] = whole[k].replace(f"from {name} ", f"from w_{name} ").replace(f"from {name}\n", f"from w_{name}\n")
    own = curve_sql(f'select "group", {y} from grouped where {ok}', '"group"')
    query = f"""select c."group", n, n_real, n_fake, n_failed, round(auc, 6) auc, round(ap, 6) ap, round(eer, 6) eer, round(x.threshold, 6) own_threshold,
        round(case when auc is not null then t01 end, 6) tpr_at_fpr01, round(case when auc is not null then t05 end, 6) tpr_at_fpr05, round(fpr, 6) fpr, round(fnr, 6) fnr, round(acc, 6) acc,
        round({_BAL}, 6) bal_acc, round(thr, 6) threshold, {_ENDS}, n_real < 30 or n_fake < 30 as small
        from counted c left join ivals on ivals.grp = c."group" left join areas using ("group") left join crossing x using ("group") left join tprs using ("group") left join rated using ("group") cross join whole_thr"""
    return with_views(
        query,
        *views,
        **more,
        grouped=f"select coalesce({group}, '<null>') as \"group\", item_id, label, score, status from {source}",
        **whole,
        whole_thr="select max(threshold) as thr from w_crossing",
        **interval_sql(f'select "group" as grp, item_id, {y} from grouped where {ok}'),
        **own,
        counted="""select "group", count(*) n, count(*) filter (label = 'real') n_real, count(*) filter (label = 'fake') n_fake, count(*) filter (status <> 'ok') n_failed from grouped group by all""",
        rated=f'select "group", {_RATES} from grouped cross join whole_thr where {ok} group by all',
    )


_SUMMARY_SQL = _over_joined(
    f"""select n, n_real, n_fake, n_failed, round(auc, 6) auc, round(ap, 6) ap, round(eer, 6) eer, round(threshold, 6) threshold, round(t01, 6) tpr_at_fpr01, round(t05, 6) tpr_at_fpr05,
    round(fpr, 6) fpr, round(fnr, 6) fnr, round(acc, 6) acc, round({_BAL}, 6) bal_acc, {_ENDS} from counted, areas, crossing, tprs, rated, ivals""",
    **interval_sql("select 'all' as grp, item_id, case when label = 'fake' then 1 else 0 end as y, score as s from joined where status = 'ok' and score is not null"),
    counted="select count(*) n, count(*) filter (label = 'real') n_real, count(*) filter (label = 'fake') n_fake, count(*) filter (status <> 'ok') n_failed from joined",
    rated=f"select {_RATES} from (select *, (select threshold from crossing) as thr from joined) where status = 'ok' and score is not null",
)

_BOOT_SQL = with_views(
    "select replicate, round(auc, 6) auc, round(eer, 6) eer from areas join crossing using (replicate)",
    *_VIEWS,
    joined=_JOINED,
    base="select case when label = 'fake' then 1 else 0 end as y, score as s, row_number() over (partition by case when label = 'fake' then 1 else 0 end order by sha1(item_id), item_id) - 1 as rank from joined where status = 'ok' and score is not null",
    sizes="select y, count(*) as size from base group by y",
    draws=f"""select replicate, b.y, cast(concat('0x', substr(sha1(concat('0:', cast(replicate as varchar), ':', cast(b.y as varchar), ':', cast(rank as varchar))), 1, 8)) as bigint) % size as rank
        from base b join sizes using (y) cross join (select range as replicate from range({REPLICATES}))""",
    hits="select replicate, y, rank, count(*) as w from draws group by all",
    **curve_sql("select replicate, hits.y, s, w from hits join base on hits.y = base.y and hits.rank = base.rank", "replicate", "w"),
)


# --- probes -------------------------------------------------------------------------------------------------------
def _doc_features(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("item_id"), F.length("text").cast("double").alias("chars"), (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("double").alias("breaks"), F.octet_length("text").cast("double").alias("octets"))
    return t.doc_items(spark, d).select("item_id", "label").join(docs, "item_id", "left")


_FEATURES = ["chars", "breaks", "octets"]
_FEATURES_SQL = "select concat('documents/', cast(doc_id as varchar)) as item_id, length(text)::double as chars, (length(text) - length(replace(text, chr(10), '')))::double as breaks, strlen(text)::double as octets from documents"


def feature_join(spark: SparkSession, d: str) -> DataFrame:
    return _doc_features(spark, d)


def feature_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shortcut.feature_aucs(_doc_features(spark, d), _FEATURES))


def class_means(spark: SparkSession, d: str) -> DataFrame:
    return shortcut.class_means(_doc_features(spark, d), _FEATURES)


def probe_oof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shortcut.probe(_doc_features(spark, d), _FEATURES))


def clip_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of made-up clips: each vector, repeated, is a waveform."""
    clips = t.table(spark, d, "embeddings").select(F.concat(F.lit("clip/"), F.col("vec_id").cast("string")).alias("item_id"), F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double")), 60)).alias("wave"), F.lit(44100.0).alias("original_rate"))
    return rounded(shortcut.features(clips, 16000), 4)


class _MeanSigmoid(scoring.Scorer):
    def score(self, inputs):  # noqa: ANN001, ANN201
        return inputs.map(lambda v: 1 / (1 + pow(2.718281828459045, -sum(map(float, v)) / len(v))))


def dummy_scorer(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "embeddings").select("vec_id", F.round(scoring.dummy_score(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("score"))


def plugin_scorer(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.run_scorer(t.table(spark, d, "embeddings").select("vec_id", "embedding"), _MeanSigmoid(), "embedding", "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"), "status")


def score_checks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_checks(scores(spark, d), ("ok", "too_short"))


_DUMMY = "round(1 / (1 + exp(-list_avg(list_transform(embedding, lambda x: x::double)))), 6)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "item_mean": (_items("mean"), _items_sql("avg(unit_score)")),
    "item_max": (_items("max"), _items_sql("max(unit_score)")),
    "item_median": (_items("median"), _items_sql("quantile_cont(unit_score, 0.5)")),
    "score_join": (score_join, with_views("select item_id, label, g_segment, score, status, n_windows from joined", *_VIEWS, joined=_JOINED)),
    "unscored_count": (unscored_count, with_views("select count(*) as unscored_items from order_items where item_id not in (select item_id from order_scores)", *_VIEWS)),
    "failures_by_status": (failures_by_status, with_views("select status, count(*) as n from order_scores where status <> 'ok' group by status", *_VIEWS)),
    "overall_summary": (overall_summary, _SUMMARY_SQL),
    "roc_curve": (roc_curve, _over_joined("select round(threshold, 6) threshold, round(fpr, 6) fpr, round(tpr, 6) tpr from verts")),
    "auc": (auc, _over_joined("select round(auc, 6) auc from areas")),
    "eer": (eer, _over_joined("select round(eer, 6) eer, round(threshold, 6) threshold from crossing")),
    "rates_at_threshold": (rates_at_threshold, with_views(f"select round(fpr, 6) fpr, round(fnr, 6) fnr from (select {_RATES} from (select *, 0.5 as thr from joined) where status = 'ok')", *_VIEWS, joined=_JOINED)),
    "accuracy_at_threshold": (accuracy_at_threshold, with_views(f"select round(acc, 6) acc, round({_BAL}, 6) bal_acc from (select {_RATES} from (select *, 0.5 as thr from joined) where status = 'ok')", *_VIEWS, joined=_JOINED)),
    "tpr_at_fpr": (tpr_at_fpr, _over_joined("select round(t01, 6) tpr_at_fpr01, round(t05, 6) tpr_at_fpr05 from tprs")),
    "average_precision": (average_precision, _over_joined("select round(ap, 6) ap from areas")),
    "score_direction": (score_direction, _over_joined("select coalesce(auc > 0.5, false) as direction_ok from areas")),
    "per_group_metrics": (per_group_metrics, _group_sql("joined", "g_segment", *_VIEWS, joined=_JOINED)),
    "doc_group_metrics": (doc_group_metrics, _group_sql("doc_items", "language", "doc_items")),
    "bootstrap_hash": (bootstrap_hash, _BOOT_SQL),
    "bootstrap_intervals": (
        bootstrap_intervals,
        with_views(
            f"select grp as g_segment, {_ENDS} from ivals",
            *_VIEWS,
            joined=_JOINED,
            **interval_sql("select coalesce(g_segment, '<null>') as grp, item_id, case when label = 'fake' then 1 else 0 end as y, score as s from joined where status = 'ok' and score is not null"),
        ),
    ),
    "metric_intervals": (
        metric_intervals,
        with_views(
            """select grp as language, round(quantile_cont(ap, 0.025), 6) ap_lo, round(quantile_cont(ap, 0.975), 6) ap_hi, round(quantile_cont(t01, 0.025), 6) tpr_at_fpr01_lo,
                round(quantile_cont(t01, 0.975), 6) tpr_at_fpr01_hi, round(quantile_cont(t05, 0.025), 6) tpr_at_fpr05_lo, round(quantile_cont(t05, 0.975), 6) tpr_at_fpr05_hi from m_vals group by grp""",
            "doc_items",
            **interval_sql("select coalesce(language, '<null>') as grp, item_id, case when label = 'fake' then 1 else 0 end as y, score as s from doc_items where status = 'ok' and score is not null"),
            m_vals="""select grp, r, sum(dtp / P * tps / (tps + fps)) as ap, coalesce(max(tps / P) filter (fps / N <= 0.01), 0) as t01, coalesce(max(tps / P) filter (fps / N <= 0.05), 0) as t05
                from i_cum where P > 0 and N > 0 group by all""",
        ),
    ),
    "bootstrap_exact": (bootstrap_exact, None),
    "feature_join": (feature_join, with_views("select item_id, label, chars, breaks, octets from doc_items left join f using (item_id)", "doc_items", f=_FEATURES_SQL)),
    "feature_auc": (
        feature_auc,
        with_views("select feature, round(greatest(auc, 1 - auc), 6) auc from areas", "doc_items", f=_FEATURES_SQL, **curve_sql("select feature, case when label = 'fake' then 1 else 0 end as y, s from (unpivot (select label, chars, breaks, octets from doc_items join f using (item_id)) on chars, breaks, octets into name feature value s)", "feature")),
    ),
    "class_means": (class_means, with_views("select label, round(avg(chars), 4) chars, round(avg(breaks), 4) breaks, round(avg(octets), 4) octets from doc_items left join f using (item_id) group by label", "doc_items", f=_FEATURES_SQL)),
    "probe_oof": (probe_oof, None),
    "clip_features": (clip_features, None),
    "dummy_scorer": (dummy_scorer, f"select vec_id, {_DUMMY} as score from embeddings"),
    "plugin_scorer": (plugin_scorer, f"select vec_id, {_DUMMY} as score, 'ok' as status from embeddings"),
    "score_checks": (score_checks, with_views("select count(*) filter (status not in ('ok', 'too_short')) unknown_status, count(*) filter (status = 'ok' and not coalesce(score between 0 and 1, false)) bad_score, count(*) filter (status <> 'ok' and score is not null) failed_with_score from order_scores", *_VIEWS)),
}
