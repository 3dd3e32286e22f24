"""Canonical JSON against Python's own encoder over nested values; digests of files of all sizes."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from scoreloom.functions import digests


def value(draw, depth=0):
    kind = draw.randrange(9 if depth < 4 else 6)
    if kind > 6:
        return {"".join(draw.choices('abZ é"\\\n日', k=draw.randint(0, 4))): value(draw, depth + 1) for _ in range(draw.randint(0, 4))}
    if kind == 6:
        return [value(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return [None, True, draw.randint(-(10**20), 10**20), draw.uniform(-1e20, 1e20), 10.0 ** draw.randint(-30, 30), "".join(draw.choices("ab/\t \x7f😀é", k=5))][kind]


def test_nested_values_in_any_order(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        v = value(draw)
        shuffled = json.dumps({k: v[k] for k in draw.sample(list(v), len(v))} if isinstance(v, dict) else v, ensure_ascii=bool(i % 2), indent=i % 3 or None)
        rows.append((i, shuffled, json.dumps(v, sort_keys=True, separators=(",", ":"))))
    frame = spark.createDataFrame(rows, "i long, text string, wanted string")
    got = frame.select("wanted", digests.canonical_json("text").alias("c"), digests.config_hash(F.col("text")).alias("h")).collect()
    assert all(r.c == r.wanted and r.h == hashlib.sha256(r.wanted.encode()).hexdigest() for r in got)


def test_odd_texts(spark):
    rows = [(None, None), ("", None), ("{", None), ('{"a":1,"a":2}', '{"a":2}'), ("[" * 100_000, None), (" 1.0 ", "1.0"), ('{"b":{"d":1,"c":NaN}}', '{"b":{"c":NaN,"d":1}}')]
    frame = spark.createDataFrame(rows, "text string, wanted string")
    assert all(r.c == r.wanted for r in frame.select("wanted", digests.canonical_json("text").alias("c")).collect())
    one = spark.createDataFrame([(1, None, "x")], "b int, a string, c string").select(digests.row_hash("b", "a", "c").alias("h")).first().h
    assert one == hashlib.sha256(b'{"a":null,"b":1,"c":"x"}').hexdigest()


def test_files(spark, tmp_path):
    files = {"a.bin": b"", "d/b.bin": b"x" * 5_000, "d/e/c.bin": bytes(range(256)) * 9_000, "d/skip.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for whole in (0, 6_000, 1 << 28):
        got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in digests.file_digests(spark, str(tmp_path), "*.bin", whole).collect()}
        assert got == {n.rsplit("/", 1)[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items() if n.endswith(".bin")}
