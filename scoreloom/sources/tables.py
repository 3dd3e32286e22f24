"""The evaluation views over the relational test tables: items, scored units, scores, frames, samples and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scored unit of an item."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("item_id"),
        F.col("l_linenumber").alias("unit_idx"),
        (F.col("l_discount").cast("double") * 10).alias("unit_score"),
        (F.col("l_quantity").cast("double") / 1000).alias("load_s"),
        F.col("l_tax").cast("double").alias("infer_s"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table: labels, groups and identities."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.where(F.col("o_orderstatus").isin("F", "O")).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    key, year = F.col("o_orderkey").cast("string"), F.year("o_orderdate")
    known = F.col("o_orderkey") % 50 != 0
    fake = F.col("o_orderstatus") == "F"
    return rows.select(
        F.concat(F.lit("orders/"), key).alias("item_id"),
        F.lit("orders").alias("dataset"),
        F.concat(F.lit("y"), year.cast("string"), F.lit("/"), key, F.lit(".wav")).alias("rel_path"),
        F.lit("audio").alias("modality"),
        F.when(fake, "fake").otherwise("real").alias("label"),
        F.when(fake, F.col("o_orderpriority")).alias("method"),
        F.lower("n_name").alias("language"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject_id"),
        F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string"))).alias("source_subject_id"),
        F.when(year < 1997, "train").otherwise("test").alias("split"),
        F.when(known, F.col("c_mktsegment")).alias("g_segment"),
        F.when(known, "dataset").alias("g_segment_src"),
    )


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as items of two tracks, scored by length."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    short = F.col("n_chars") < 200
    return d.select("doc_id", "lang", "source", "n_chars").join(y, "doc_id").select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("item_id"),
        F.lit("documents").alias("dataset"),
        F.col("lang").alias("language"),
        F.col("source").alias("method"),
        F.when(F.col("quality") == 0, "fake").otherwise("real").alias("label"),
        F.when(F.col("toxic") == 1, "fake").otherwise("real").alias("label_audio"),
        F.when(short, "too_short").otherwise("ok").alias("status"),
        F.when(~short, F.round(F.lit(1000.0) / (F.lit(1000.0) + F.col("n_chars")), 9)).alias("score"),
        "n_chars",
    )


def conv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered frames with gaps: a null box is a frame without a find."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("item_id"),
        F.col("turn").alias("frame_index"),
        F.when(F.col("role") == "assistant", F.length("text").cast("double")).alias("box"),
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples of a session, in the order of (ts, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.col("event_type").alias("phase"), F.col("value").alias("watts"))


def parity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of scores of one unit."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), (F.col("p_retailprice") / 1000).alias("adapter"), F.round(F.col("p_retailprice") / 1000, 3).alias("reference"))


#: The same views as DuckDB common table expressions.
VIEWS_SQL = {
    "order_windows": """select concat('orders/', cast(l_orderkey as varchar)) as item_id, l_linenumber as unit_idx,
        cast(l_discount as double) * 10 as unit_score, cast(l_quantity as double) / 1000 as load_s, cast(l_tax as double) as infer_s
        from lineitem""",
    "order_items": """select concat('orders/', cast(o_orderkey as varchar)) as item_id, 'orders' as dataset,
        concat('y', cast(year(o_orderdate) as varchar), '/', cast(o_orderkey as varchar), '.wav') as rel_path, 'audio' as modality,
        case when o_orderstatus = 'F' then 'fake' else 'real' end as label, case when o_orderstatus = 'F' then o_orderpriority end as method,
        lower(n_name) as language, concat('c', cast(o_custkey as varchar)) as subject_id,
        case when o_orderkey % 97 = 0 then concat('c', cast(o_custkey + 1 as varchar)) end as source_subject_id,
        case when year(o_orderdate) < 1997 then 'train' else 'test' end as split,
        case when o_orderkey % 50 = 0 then null else c_mktsegment end as g_segment,
        case when o_orderkey % 50 = 0 then null else 'dataset' end as g_segment_src
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus in ('F', 'O')""",
    "order_scores": """select item_id, case when count(*) >= 2 then round(avg(unit_score), 9) end as score,
        cast(case when count(*) >= 2 then count(*) else 0 end as bigint) as n_windows,
        case when count(*) >= 2 then 'ok' else 'too_short' end as status,
        round(sum(load_s), 9) as load_s, case when count(*) >= 2 then round(sum(infer_s), 9) end as infer_s
        from order_windows group by item_id""",
    "doc_items": """select concat('documents/', cast(d.doc_id as varchar)) as item_id, 'documents' as dataset, d.lang as language,
        d.source as method, case when y.quality = 0 then 'fake' else 'real' end as label,
        case when y.toxic = 1 then 'fake' else 'real' end as label_audio,
        case when d.n_chars < 200 then 'too_short' else 'ok' end as status,
        case when d.n_chars < 200 then null else round(cast(1000 as double) / (cast(1000 as double) + d.n_chars), 9) end as score, d.n_chars
        from documents d join labels y on d.doc_id = y.doc_id""",
    "conv_frames": """select concat('conv/', cast(conv_id as varchar)) as item_id, turn as frame_index,
        case when role = 'assistant' then cast(length(text) as double) end as box from conversations""",
    "event_samples": "select user_id as session_id, ts, event_id, event_type as phase, value as watts from events",
    "parity_units": "select p_partkey as unit, p_retailprice / 1000 as adapter, round(p_retailprice / 1000, 3) as reference from part",
}
_NEEDS = {"order_scores": ("order_windows",)}


def crc_sql(text: str) -> str:
    """The CRC-32 of ASCII text in DuckDB, a bit at a time."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)),
        lambda s, b: list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def with_views(query: str, *views: str, **more: str) -> str:
    """``query`` after the definitions of the views it uses, and of ``more`` expressions in their order."""
    names = list(dict.fromkeys(v for name in views for v in (*_NEEDS.get(name, ()), name)))
    parts = [f"{n} as ({VIEWS_SQL[n]})" for n in names] + [f"{n} as ({sql})" for n, sql in more.items()]
    return f"with recursive {', '.join(parts)} {query}" if parts else query
