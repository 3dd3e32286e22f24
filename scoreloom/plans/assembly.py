"""Queries that build and check item tables and evaluation sets; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evalset, lineage, manifest, sampling, scoring, splits
from ..sources import readers
from ..sources import tables as t
from ..sources.tables import with_views
from . import registry
from .detection import Query, scores


def _rank(seed: int, key: str) -> str:
    return f"sha1(concat('{seed}:', {key}))"


# --- sets ---------------------------------------------------------------------------------------------------------
def evalset_filter(spark: SparkSession, d: str) -> DataFrame:
    items = evalset.apply_filter(t.order_items(spark, d), {"split": "test", "language": ["germany", "france", "japan"]})
    return items.select("item_id", "label", "language")


def evalset_relabel(spark: SparkSession, d: str) -> DataFrame:
    return evalset.relabel(t.doc_items(spark, d), "from_audio").select("item_id", "label")


def evalset_union(spark: SparkSession, d: str) -> DataFrame:
    orders = evalset.apply_filter(t.order_items(spark, d), {"split": "test"}).select("item_id", "dataset", "label", "language", "g_segment")
    docs = evalset.relabel(t.doc_items(spark, d), "fake").select("item_id", "dataset", "label", "language")
    return evalset.union([orders, docs])


def evalset_problems(spark: SparkSession, d: str) -> DataFrame:
    items = evalset.relabel(t.doc_items(spark, d).select("item_id", "label"), "fake")
    return evalset.set_problems(evalset.union([items, items]))


def subset_stratified(spark: SparkSession, d: str) -> DataFrame:
    return evalset.subset(t.order_items(spark, d), 5, ["label", "method", "g_segment"]).select("item_id", "label", "method", "g_segment")


def choose_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.choose(t.order_items(spark, d), 4, "language").select("item_id", "label", "language", "place")


def pick_balanced(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pick_balanced(t.doc_items(spark, d), 200).select("item_id", "label")


def shard_partition(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shards(t.order_items(spark, d), 7).select("item_id", "shard")


def mark_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.mark(t.doc_items(spark, d), 10, ["language", "method"]).select("item_id", "sampled")


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = scores(spark, d).where("status = 'ok'")
    return scoring.unscored(t.order_items(spark, d), done).select("item_id")


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    done = scores(spark, d).where("status <> 'ok'")
    return scoring.cached(t.order_items(spark, d), done).agg(F.count("*").alias("hits"))


def exclude_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents without those whose id is on the list of items seen in training."""
    seen = t.table(spark, d, "benchmark").select(F.concat(F.lit("documents/"), F.col("item_id").cast("string")).alias("item_id"))
    return t.doc_items(spark, d).join(seen, "item_id", "left_anti").select("item_id", "label")


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = t.order_items(spark, d).where("split = 'test'").select("subject_id"), t.order_items(spark, d).where("split = 'train'").select("subject_id")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.distinct().join(b, "subject_id", "left_anti").withColumn("part", F.lit("test only")))


def scores_union(spark: SparkSession, d: str) -> DataFrame:
    """Parts of different ages: an older one lacks the times."""
    s = scores(spark, d)
    old, new = s.where("n_windows % 2 = 0").select("item_id", "score", "n_windows", "status"), s.where("n_windows % 2 = 1")
    return old.unionByName(new, allowMissingColumns=True).select("item_id", "status", "n_windows", F.round("load_s", 6).alias("load_s"))


# --- manifests ----------------------------------------------------------------------------------------------------
def _broken(spark: SparkSession, d: str) -> DataFrame:
    items = t.order_items(spark, d)
    hit = F.substring(F.sha1("item_id"), 1, 1)
    return items.withColumns(
        {
            "label": F.when(hit == "0", F.lit("maybe")).otherwise(F.col("label")),
            "modality": F.when(hit == "1", F.lit("smell")).otherwise(F.col("modality")),
            "g_segment": F.when(hit == "2", F.lit("Unknown")).otherwise(F.col("g_segment")),
            "g_segment_src": F.when(hit == "3", F.lit("guess")).otherwise(F.col("g_segment_src")),
        }
    )


_BROKEN_SQL = """select * replace (case when h = '0' then 'maybe' else label end as label, case when h = '1' then 'smell' else modality end as modality,
    case when h = '2' then 'Unknown' else g_segment end as g_segment, case when h = '3' then 'guess' else g_segment_src end as g_segment_src)
    from (select *, substr(sha1(item_id), 1, 1) as h from order_items)"""


def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    return manifest.problems(_broken(spark, d), "orders")


_PROBLEMS_SQL = with_views(
    """select problem from (
    select 'label must be real or fake, found ' || string_agg(distinct label, ', ' order by label) as problem from b where label not in ('real', 'fake') having count(*) > 0
    union all select 'unknown modalities ' || string_agg(distinct modality, ', ' order by modality) from b where modality <> 'audio' having count(*) > 0
    union all select 'g_segment_src has unknown sources ' || string_agg(distinct g_segment_src, ', ' order by g_segment_src) from b where g_segment_src <> 'dataset' having count(*) > 0
    union all select 'g_segment_src must be set wherever g_segment has a value' from b where g_segment is not null and g_segment_src is null having count(*) > 0
    union all select 'g_segment uses a placeholder; use null for unknown' from b where lower(g_segment) in ('unknown', 'n/a', 'na', 'none', '') having count(*) > 0)""",
    "order_items",
    b=_BROKEN_SQL,
)


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.summarise(t.order_items(spark, d))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return manifest.content_hash(t.order_items(spark, d))


def ranged_hash(spark: SparkSession, d: str) -> DataFrame:
    return manifest.ranged_hash(t.order_items(spark, d))


def normalise_attr(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("c_custkey") % 7 == 0, F.lit(" N/A ")).when(F.col("c_custkey") % 11 == 0, F.lit("Unknown")).otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return t.table(spark, d, "customer").select("c_custkey", scalar.normalise_attr(c).alias("segment"))


def path_builder(spark: SparkSession, d: str) -> DataFrame:
    """Attributes from a page's path: host, folders, file stem, number."""
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    parts = F.split(path, "/")
    return t.table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        F.size(parts).cast("long").alias("depth"),
        F.lower(parts[0]).alias("language"),
        scalar.stem(path).alias("stem"),
        F.regexp_extract(path, r"(\d+)$", 1).alias("number"),
    )


def html_sniff(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\n  "), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x"), "html")).otherwise(F.col("html"))
    return t.table(spark, d, "pages").select("page_id", scalar.looks_like_html(text).alias("is_html"))


def safe_relpath(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "url")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), "url")).when(F.col("page_id") % 5 == 2, F.lit("")).when(F.col("page_id") % 5 == 3, F.lit("a\\b")).otherwise(F.col("url"))
    return t.table(spark, d, "pages").select("page_id", scalar.safe_relpath(path).alias("safe"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").where(F.col("url").rlike(scalar.glob_pattern("https://*.example.???/en/*[0-4]"))).select("page_id", "url")


def metadata_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels from a protocol of five fields, joined by key; other lines are skipped."""
    line = F.when(F.col("doc_id") % 10 == 0, F.lit("broken line")).otherwise(F.format_string("S1 %d  - A%d %s", "doc_id", F.col("doc_id") % 3, F.when(F.col("quality") == 0, "spoof").otherwise("bonafide")))
    lines = readers.protocol(t.table(spark, d, "labels").select(line.alias("value")))
    found = lines.select(F.col("f")[1].cast("long").alias("doc_id"), F.when(F.col("f")[4] == "spoof", "fake").otherwise("real").alias("label"), F.nullif(F.col("f")[2], F.lit("-")).alias("codec"))
    return t.table(spark, d, "documents").select("doc_id").join(found, "doc_id")


def unquoted_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = t.table(spark, d, "customer").select(F.concat(F.lit('"'), "c_name", F.lit("\t"), "c_mktsegment").alias("value"))
    return readers.unquoted_tsv(lines).select(F.col("f")[0].alias("name"), F.col("f")[1].alias("segment"))


def official_split(spark: SparkSession, d: str) -> DataFrame:
    """The second field of each line of a list names the test items."""
    listed = t.table(spark, d, "labels").where("doc_id % 4 = 1").select(F.concat(F.lit("1 documents/"), F.col("doc_id").cast("string")).alias("value")).select(F.split("value", " ")[1].alias("item_id"), F.lit(True).alias("listed"))
    return t.doc_items(spark, d).join(listed, "item_id", "left").select("item_id", F.when(F.col("listed"), "test").otherwise("train").alias("split"))


def magic_bytes(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*(F.lit(x) for x in (b"RIFFxx", b"fLaCxx", b"OggSxx", b"ID3xx", b"\xff\xfbx", b"zz")))
    rows = t.table(spark, d, "customer").select("c_custkey", heads[(F.col("c_custkey") % 6).cast("int")].alias("data"), F.when(F.col("c_custkey") % 5 == 0, F.lit("a/b.MP3")).otherwise(F.lit("clip")).alias("stored"))
    return rows.select("c_custkey", scalar.audio_suffix(F.col("stored"), F.col("data")).alias("suffix"))


def source_row(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_rows(spark, f"{d}/part.parquet", ["p_partkey"])


# --- registry -----------------------------------------------------------------------------------------------------
def _closure(spark: SparkSession) -> DataFrame:
    edges = registry.frame(spark, "reg_edges")
    names = registry.frame(spark, "reg_datasets").select(F.col("dataset").alias("node")).unionByName(registry.frame(spark, "reg_corpora").select(F.col("corpus").alias("node")))
    nodes = names.unionByName(registry.frame(spark, "reg_training").select(F.col("dataset").alias("node"))).unionByName(registry.frame(spark, "reg_components").select(F.col("dataset").alias("node")))
    return lineage.closure(nodes.distinct(), edges)


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark)


def contamination_verdict(spark: SparkSession, d: str) -> DataFrame:
    return lineage.verdicts(registry.frame(spark, "reg_components"), registry.frame(spark, "reg_training"), _closure(spark))


def archive_restricted(spark: SparkSession, d: str) -> DataFrame:
    runs = registry.frame(spark, "reg_runs").select("run_id", F.when(F.col("run_id") == "r9", "es_unknown").otherwise(F.col("evalset")).alias("evalset"))
    return lineage.restricted(runs, registry.frame(spark, "reg_components").select("evalset", "dataset"), _closure(spark), ["co_read"])


def accept_matrix(spark: SparkSession, d: str) -> DataFrame:
    return lineage.accept_matrix(registry.frame(spark, "reg_models"), registry.frame(spark, "reg_sets"))


def registry_problems(spark: SparkSession, d: str) -> DataFrame:
    return lineage.registry_problems(*(registry.frame(spark, f"reg_{n}") for n in ("models", "datasets", "corpora", "components", "training", "edges")))


_REG = {n: registry.sql(n) for n in registry.TABLES}
CLOSURE_SQL = {
    "nodes": "select dataset as node from reg_datasets union select corpus from reg_corpora union select dataset from reg_training union select dataset from reg_components",
    "closure": "select node as source, node from nodes union select c.source, e.parent from closure c join reg_edges e on c.node = e.node",
}
VERDICT_SQL = {
    "ups": "select source, list_sort(list(node)) as up from closure group by source",
    "pairs": """select c.evalset, c.position cp, c.dataset cd, c.splits, m.model, m.position tp, m.dataset td, m.level, m.split, m.items_file,
        list_sort(list_intersect(coalesce(a.up, [c.dataset]), coalesce(b.up, [m.dataset]))) as shared
        from reg_components c cross join reg_training m left join ups a on a.source = c.dataset left join ups b on b.source = m.dataset""",
    "judged": """select *, case when td = cd and split is not null and splits is not null and not list_contains(splits, split) then 0 when td = cd and level = 'pretrain' then 1
        when td = cd and items_file is not null then 2 when td = cd then 3 when len(shared) > 0 then 1 else 0 end as v,
        case when td = cd and split is not null and splits is not null and not list_contains(splits, split) then 'other split of ' || td || ': ' || split when td = cd and level = 'pretrain' then 'pretrained on ' || td
        when td = cd and items_file is not null then level || ' data includes ' || td || '; excluding ' || items_file when td = cd then level || ' data includes ' || td
        when len(shared) > 0 then level || ' data ' || td || ' shares ' || array_to_string(shared, '+') || ' with ' || cd end as reason from pairs""",
    "verdicts": """select model, evalset, ['clean', 'source_overlap', 'overlap_excluded', 'contaminated'][max(v) + 1] as verdict,
        coalesce(string_agg(reason, '; ' order by cp, tp), '') as reasons, coalesce(string_agg(distinct case when v = 2 then items_file end, ','), '') as exclude from judged group by all""",
}
ACCEPT_SQL = """select model, evalset, case m.modality when 'video' then e.modality in ('video', 'image', 'audio_video') when 'image' then e.modality = 'image'
    when 'audio' then e.modality in ('audio', 'audio_video') else e.modality = 'audio_video' end as accepted from reg_models m cross join reg_sets e"""


def _reg(query: str, **more: str) -> str:
    return with_views(query, **_REG, **more)


_REGISTRY_SQL = _reg(
    """select 'dataset and corpus: ' || dataset as problem from reg_datasets where dataset in (select corpus from reg_corpora)
    union all select 'model ' || model || ': unknown training data ' || dataset from reg_training where dataset not in (select node from known)
    union all select 'dataset ' || node || ': unknown source ' || parent from reg_edges where parent not in (select node from known)
    union all select 'model ' || model || ': in a wave but ' || status from reg_models where wave is not null and status not in ('ready', 'workable')
    union all select 'set ' || evalset || ': unknown dataset ' || dataset from reg_components where dataset not in (select dataset from reg_datasets)
    union all select 'set ' || evalset || ': ' || modality || ' set uses ' || dm || ' ' || dataset from c where modality <> dm and dm <> 'audio_video'
    union all select 'set ' || evalset || ': mixes roles with ' || dataset from c where (dr = 'pipeline_test') <> (role = 'pipeline_test')
    union all select 'set ' || evalset || ': ' || dataset || ' has no ' || label_rule || ' items' from c where label_rule in ('real', 'fake') and not list_contains(contains, label_rule)
    union all select 'set ' || evalset || ': no tracks in ' || dataset from c where label_rule in ('from_video', 'from_audio') and dm <> 'audio_video'""",
    known="select dataset as node from reg_datasets union select corpus from reg_corpora",
    c="select c.*, d.modality dm, d.role dr, d.contains from reg_components c join reg_datasets d on c.dataset = d.dataset",
)


# --- splits -------------------------------------------------------------------------------------------------------
def identity_components(spark: SparkSession, d: str) -> DataFrame:
    return splits.identity_components(t.order_items(spark, d))


def identity_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.identity_split(t.order_items(spark, d), {"train": 0.7, "val": 0.1, "test": 0.2})


_COMPONENTS_SQL = with_views(
    "select item_id, coalesce('id:' || coalesce(lab.label, subject_id, source_subject_id), 'item:' || item_id) as component from order_items left join lab on coalesce(subject_id, source_subject_id) = lab.node",
    "order_items",
    e="select distinct subject_id a, source_subject_id b from order_items where subject_id is not null and source_subject_id is not null and subject_id <> source_subject_id",
    edge="select a, b from e union select b, a from e",
    reach="select a as node, a as other from edge union select r.node, edge.b from reach r join edge on r.other = edge.a",
    lab="select node, min(other) as label from reach group by node",
)

QUERIES: dict[str, tuple[Query, str | None]] = {
    "evalset_filter": (evalset_filter, with_views("select item_id, label, language from order_items where split = 'test' and language in ('germany', 'france', 'japan')", "order_items")),
    "evalset_relabel": (evalset_relabel, with_views("select item_id, label_audio as label from doc_items", "doc_items")),
    "evalset_union": (evalset_union, with_views("select item_id, dataset, label, language, g_segment, 0 as component from order_items where split = 'test' union all select item_id, dataset, 'fake', language, null, 1 from doc_items", "order_items", "doc_items")),
    "evalset_problems": (evalset_problems, with_views("select concat(cast(count(distinct item_id) as varchar), ' ids more than once') as problem from doc_items union all select 'no real items'", "doc_items")),
    "subset_stratified": (subset_stratified, with_views(f"select item_id, label, method, g_segment from order_items qualify row_number() over (partition by label, method, g_segment order by {_rank(0, 'item_id')}) <= 5", "order_items")),
    "choose_sample": (choose_sample, with_views(f"select item_id, label, language, cast(row_number() over (partition by label, language order by {_rank(0, 'rel_path')}) as integer) as place from order_items qualify place <= 4", "order_items")),
    "pick_balanced": (
        pick_balanced,
        with_views(
            "select item_id, label from r cross join h where n <= case when label = 'real' then q else least(f, 200 - q) end",
            "doc_items",
            r=f"select item_id, label, row_number() over (partition by label order by {_rank(0, 'item_id')}) as n from doc_items",
            h="select count(*) filter (label = 'fake') as f, least(count(*) filter (label = 'real'), greatest(100, 200 - count(*) filter (label = 'fake'))) as q from doc_items",
        ),
    ),
    "shard_partition": (shard_partition, with_views("select item_id, cast(cast(concat('0x', substr(sha1(item_id), 1, 8)) as bigint) % 7 as integer) as shard from order_items", "order_items")),
    "mark_sample": (mark_sample, with_views(f"select item_id, row_number() over (partition by language, method order by {_rank(0, 'item_id')}) <= 10 as sampled from doc_items", "doc_items")),
    "resume_antijoin": (resume_antijoin, with_views("select item_id from order_items where item_id not in (select item_id from order_scores where status = 'ok')", "order_items", "order_scores")),
    "cache_hits": (cache_hits, with_views("select count(*) as hits from order_items where item_id in (select item_id from order_scores where status <> 'ok')", "order_items", "order_scores")),
    "exclude_items": (exclude_items, with_views("select item_id, label from doc_items where item_id not in (select concat('documents/', cast(item_id as varchar)) from benchmark)", "doc_items")),
    "set_ops": (set_ops, with_views("select distinct subject_id, case when subject_id in (select subject_id from order_items where split = 'train') then 'both' else 'test only' end as part from order_items where split = 'test'", "order_items")),
    "scores_union": (scores_union, with_views("select item_id, status, n_windows, case when n_windows % 2 = 1 then round(load_s, 6) end as load_s from order_scores", "order_scores")),
    "manifest_problems": (manifest_problems, _PROBLEMS_SQL),
    "manifest_summary": (manifest_summary, with_views("select 'label' as attribute, '*' as value, label, count(*) as n from order_items group by label union all select 'g_segment', coalesce(g_segment, '<null>'), label, count(*) from order_items group by all", "order_items")),
    "content_hash": (content_hash, with_views("select count(*) as rows, sha256(string_agg(concat(item_id, chr(9), label, chr(10)), '' order by item_id, label)) as content_hash from order_items", "order_items")),
    "ranged_hash": (
        ranged_hash,
        with_views(
            "select cast(sum(n) as bigint) as rows, sha256(string_agg(digest, '' order by part)) as ranged_hash from parts",
            "order_items",
            parts="select substr(sha1(item_id), 1, 3) as part, count(*) as n, sha256(string_agg(concat(item_id, chr(9), label, chr(10)), '' order by item_id, label)) as digest from order_items group by 1",
        ),
    ),
    "normalise_attr": (normalise_attr, "select c_custkey, case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then null else lower(trim(c_mktsegment)) end as segment from customer"),
    "path_builder": (
        path_builder,
        """select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, len(string_split(p, '/')) as depth, lower(string_split(p, '/')[1]) as language,
        regexp_replace(string_split(p, '/')[-1], '(.)\\.[^.]*$', '\\1') as stem, regexp_extract(p, '(\\d+)$', 1) as number from (select page_id, url, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as p from pages)""",
    ),
    "html_sniff": (html_sniff, "select page_id, page_id % 3 <> 1 and (lower(html) like '<!doctype html%' or lower(html) like '<html%' or lower(html) like '<head%' or lower(html) like '<body%') as is_html from pages"),
    "safe_relpath": (safe_relpath, "select page_id, page_id % 5 = 4 and not list_contains(string_split(url, '/'), '..') and url not like '/%' and not contains(url, chr(92)) as safe from pages"),
    "glob_filter": (glob_filter, "select page_id, url from pages where url glob 'https://*.example.???/en/*[0-4]'"),
    "metadata_labels": (metadata_labels, "select d.doc_id, case when quality = 0 then 'fake' else 'real' end as label, cast(null as varchar) as codec from documents d join labels y on d.doc_id = y.doc_id where d.doc_id % 10 <> 0"),
    "unquoted_lines": (unquoted_lines, "select '\"' || c_name as name, c_mktsegment as segment from customer"),
    "official_split": (official_split, with_views("select item_id, case when cast(split_part(item_id, '/', 2) as bigint) % 4 = 1 then 'test' else 'train' end as split from doc_items", "doc_items")),
    "magic_bytes": (magic_bytes, "select c_custkey, case when c_custkey % 5 = 0 then '.mp3' else ['.wav', '.flac', '.ogg', '.mp3', '.mp3', '.bin'][c_custkey % 6 + 1] end as suffix from customer"),
    "source_row": (source_row, None),
    "registry_problems": (registry_problems, _REGISTRY_SQL),
    "accept_matrix": (accept_matrix, _reg(ACCEPT_SQL)),
    "lineage_closure": (lineage_closure, _reg("select source, node from closure", **CLOSURE_SQL)),
    "contamination_verdict": (contamination_verdict, _reg("select * from verdicts", **CLOSURE_SQL, **VERDICT_SQL)),
    "archive_restricted": (
        archive_restricted,
        _reg(
            "select r.run_id, r.evalset, coalesce(bad, true) as restricted from r left join b using (evalset)",
            **CLOSURE_SQL,
            r="select run_id, case when run_id = 'r9' then 'es_unknown' else evalset end as evalset from reg_runs",
            b="select evalset, bool_or(node = 'co_read') as bad from reg_components c left join closure on closure.source = c.dataset group by evalset",
        ),
    ),
    "identity_components": (identity_components, _COMPONENTS_SQL),
    "identity_split": (identity_split, None),
}
