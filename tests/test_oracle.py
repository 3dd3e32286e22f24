"""Every query with SQL against DuckDB on the smallest tables: columns, rows and values."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {k for k in entry.queries() if k.startswith("op") or k == "pipeline"}  # these have their own tests


def value(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x.hex() if isinstance(x, (bytes, bytearray)) else [value(v) for v in x] if isinstance(x, list) else x


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(str([value(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    ours, theirs = multiset(got.columns, got.collect()), multiset(names, rows)
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_runs_alike_without_sql(spark, name):
    """Rows at all, and the same ones again from other numbers of partitions."""
    query, seen = entry.queries()[name], []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = query(spark, SF)
        seen.append(multiset(got.columns, got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and sum(seen[0].values()) > 0


def test_source_row_is_the_row_in_its_file(spark, duck):
    got = entry.queries()["source_row"](spark, SF)
    key = next(c for c in got.columns if c not in ("shard", "source_row"))
    name = got.select("shard").first()[0]
    rows = duck.execute(f"select {key}, file_row_number from read_parquet('{SF}/{name}', file_row_number = true)").fetchall()
    assert sorted((r[key], r.source_row) for r in got.collect()) == sorted(rows)
