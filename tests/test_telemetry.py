"""Sampled telemetry of many small sessions against SQL: halves fall alike."""

import duckdb

import __spark_entry__ as entry


def test_sampler_stats_rounds_halves_as_sql_does(spark, tmp_path):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(
        f"""copy (select i as event_id, '2024-01-01'::timestamp + to_microseconds((hash(i) % 2592000000000)::bigint) as ts, (hash(i * 3 + 1) % 3000)::bigint as user_id,
        'view' as event_type, (hash(i * 7 + 5) % 30000)::bigint / 100.0::double as value, '' as props from range(40000) r(i)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cur = con.execute(entry.oracle_sql()["sampler_stats"])
    names, theirs = [d[0] for d in cur.description], sorted(cur.fetchall())
    ours = sorted(tuple(r) for r in entry.queries()["sampler_stats"](spark, str(tmp_path)).select(names).collect())
    assert len(ours) > 2900 and ours == theirs


def test_sampler_stats_with_missing_times_as_sql_has_them(spark, tmp_path):
    """Samples without a time stand last and end no session; a session may have only such ones."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(
        f"""copy (select i as event_id, case when hash(i * 5) % 4 > 0 and user_id >= 40 then ts end as ts, user_id, event_type, value, props from
        (select i, '2024-01-01'::timestamp + to_microseconds((hash(i) % 2592000000000)::bigint) as ts, (hash(i * 3 + 1) % 3000)::bigint as user_id,
        'view' as event_type, (hash(i * 7 + 5) % 30000)::bigint / 100.0::double as value, '' as props from range(60000) r(i))) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cur = con.execute(entry.oracle_sql()["sampler_stats"])
    names = [d[0] for d in cur.description]
    at = names.index("session_id")
    theirs = {r[at]: r for r in cur.fetchall()}
    ours = {r.session_id: tuple(r) for r in entry.queries()["sampler_stats"](spark, str(tmp_path)).select(names).collect()}
    assert len(ours) > 2900 and ours == theirs
