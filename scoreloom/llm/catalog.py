"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, convrepair, convtrie, licenses, media, mixing, packing, quality, sharding, simhash, tokencounts, toxicity, warc


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _labels, _pages, _conversations = map(_table, ("documents", "labels", "pages", "conversations"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(_conversations(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(_conversations(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        *(op1_simhash, op2_sharding, op3_mixing, op4_chunks, op5_packing, op6_warc, op7_licenses, op8_toxicity, op9_quality),
        *(op10_media, op11_token_counts, op12_prefix_trie, op13_conversation_repair),
    ]
    return {f.__name__: f for f in every}


#: The targets in closed form: sources in the order in which their caps bind; the first that doesn't sets the level.
_MIXING_SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
        md5(concat('mix:', coalesce(cast(doc_id as varchar), ''), ':', md5(coalesce(text, '')))) as key from documents),
    s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rk from d group by source),
    w as (select *, cast([5, 2, 1][(rk - 1) % 3 + 1] as double) as w, cast([0.5, 1, 1.5][(rk - 1) % 3 + 1] as double) as b,
        cast([1.5, 1, 0.5][(rk - 1) % 3 + 1] as double) as e, cast(2 * source_size as double) as cap from s),
    o as (select *, (sum(source_size) over () * cast(1.5 as double) - coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (order by cap / w, rk rows between current row and unbounded following) as level from w),
    g as (select *, least(cap, (select level from o where level <= cap / w order by cap / w, rk limit 1) * w) as target from o),
    p as (select d.doc_id, d.size, source_size, target, b, e, sum(size) over (partition by d.source order by key, size rows unbounded preceding) - size as before
        from d join g on d.source is not distinct from g.source),
    t as (select *, greatest(0, least(size, cast(round(target) as bigint) - before)) as one, greatest(0, least(size, cast(round(target) as bigint) - before - source_size)) as two from p),
    q as (select *, case when one > 0 then (before + one / cast(2 as double)) / target end as q from t)
select doc_id, size, source_size, round(target, 6) as target, cast(one + two as bigint) as taken, case when q is not null then round(least(1, q * (b + e) / (b + sqrt(b * b + (e * e - b * b) * q))), 9) end as position from q
"""

_WARC_SQL = """
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest,
    case when strlen(h) >= 100 and page_id is distinct from m and m is not null then 'revisit' else 'response' end as record_type,
    case when strlen(h) >= 100 and page_id is distinct from m then m end as refers_to
from (select page_id, h, min(page_id) over (partition by h) as m from (select page_id, coalesce(html, '') as h from pages))
"""


#: CRC-32 of a text of ASCII characters, a bit at a time; for % in a string.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(%s, ''), lambda c: ord(c)::bigint)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

#: Every conversation carries its nodes; a node's owner is its smallest member, whose path counts what the node adds.
_TRIE_SQL = f"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first,
        sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as n from conversations where conv_id is not null),
    k as (select c, c - c % 100 as base, {_CRC_SQL % "cast(c as varchar)"} % 6 as h, count(*) as size from t group by c),
    heads as (select k.c, k.h, least(k.h, coalesce(b.size, 0)) as got from k left join k b on b.c = k.base),
    turns as (select k.c, t.n as d, r, x from k join t on t.c = k.base and t.n <= k.h
        union all select t.c, t.n - heads.h + heads.got, r, x from t join heads using (c) where t.n > heads.h
        union all select c, 0, '', '' from k),
    p as (select c, d, length(x) as size, md5(string_agg(md5(concat(strlen(r), ':', r, x)), '') over (partition by c order by d)) as key from turns),
    q as (select *, lag(key) over (partition by c order by d) as parent, lead(key) over (partition by c order by d) is null as ends from p),
    m as (select key, any_value(d) as depth, any_value(parent) as parent, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(size) as own,
        sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256 from q group by key),
    kids as (select parent as key, count(*) as n_children from m where parent is not null group by parent),
    n as (select m.*, coalesce(n_children, 0) as n_children from m left join kids using (key)),
    v as (select q.key, sum(case when q.c = n.conv_id then own else 0 end) over w as saved, sum(case when q.c = n.conv_id and n_children = 0 then 1 else 0 end) over w as leaves
        from q join n using (key) window w as (partition by q.c order by q.d desc)),
    s as (select key, sum(saved) as saved, sum(leaves) as leaves from v group by key)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(leaves as bigint) as n_leaves,
    cast(saved as bigint) as saved_tokens, n.ends_sha256
from n join s using (key) left join m u on u.key = n.parent
"""


#: A fold from the last turn to the first; c holds the best (cost, letters, lines) from each of the four states.
_REPAIR_SQL = rf"""
with w as (select conv_id as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_CRC_SQL % "concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))"} % 20 as kind from conversations),
    d as (select c, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
        from w where kind <> 0),
    n as (select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as i, left(role, 1) as k from d),
    f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault, lag(k) over (partition by c order by i) || k as pair from n),
    g as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
        count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
        count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
        list({{'c': null::struct(cost bigint, letters varchar, lines varchar[])[], 'role': role, 'text': text, 'k': k, 'gone': fault in ('blank', 'duplicate'),
            'cut': case when fault = 'truncated' then 3 else 0 end}} order by i desc) as rows from f group by c),
    r as (select *, list_reduce(list_prepend({{'c': [{{'cost': 0::bigint, 'letters': '', 'lines': []::varchar[]}}, {{'cost': 6, 'letters': 'II', 'lines': ['user:', 'assistant:']}},
            {{'cost': 3, 'letters': 'I', 'lines': ['assistant:']}}, {{'cost': 0, 'letters': '', 'lines': []}}],
            'role': '', 'text': '', 'k': '', 'gone': false, 'cut': 0}}, rows),
        lambda a, x: {{'c': list_transform([list_transform([0, 1, 2, 3], lambda s: list_min(list_concat(
                [{{'cost': a.c[s + 1].cost + 4, 'letters': 'D' || a.c[s + 1].letters, 'lines': a.c[s + 1].lines}}],
                case when not x.gone then [{{'cost': a.c[case s when 2 then 4 else 3 end].cost + 3 + x.cut, 'letters': 'R' || a.c[case s when 2 then 4 else 3 end].letters,
                    'lines': list_prepend(case s when 2 then 'assistant:' else 'user:' end || x.text, a.c[case s when 2 then 4 else 3 end].lines)}}] else [] end,
                case when not x.gone and (x.k = case s when 2 then 'a' else 'u' end or (s = 0 and x.k = 's')) then
                    [{{'cost': a.c[case x.k when 's' then 2 when 'u' then 3 else 4 end].cost + x.cut, 'letters': 'K' || a.c[case x.k when 's' then 2 when 'u' then 3 else 4 end].letters,
                    'lines': list_prepend(x.role || ':' || x.text, a.c[case x.k when 's' then 2 when 'u' then 3 else 4 end].lines)}}] else [] end)))],
            lambda b: list_transform([0, 1, 2, 3], lambda s: list_min([b[s + 1],
                {{'cost': b[case s when 2 then 4 else 3 end].cost + 3, 'letters': 'I' || b[case s when 2 then 4 else 3 end].letters,
                    'lines': list_prepend(case s when 2 then 'assistant:' else 'user:' end, b[case s when 2 then 4 else 3 end].lines)}},
                {{'cost': b[case s when 2 then 3 else 4 end].cost + 6, 'letters': 'II' || b[case s when 2 then 3 else 4 end].letters,
                    'lines': list_concat(case s when 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end, b[case s when 2 then 3 else 4 end].lines)}}])))[1],
            'role': '', 'text': '', 'k': '', 'gone': false, 'cut': 0}}).c[1] as best from g)
select w.c as conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.letters, '') as audit,
    sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct c from w) w left join r on r.c is not distinct from w.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _MIXING_SQL, "op6_warc": _WARC_SQL, "op12_prefix_trie": _TRIE_SQL, "op13_conversation_repair": _REPAIR_SQL}
