"""The part log under several writers, one of which dies; the detection cache's plans and restarts."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from scoreloom.sources.cache import DetectionCache, settings_key
from scoreloom.sources.parts import PartLog


def scores(spark, ids, value=0.5):
    return spark.createDataFrame([(i, value, 1, "ok", 0.1, 0.2) for i in ids], "item_id string, score double, n_windows long, status string, load_s double, infer_s double")


def ids(df):
    return sorted(r.item_id for r in df.select("item_id").collect())


def test_a_missing_folder_is_an_empty_table(spark, tmp_path):
    log = PartLog(spark, str(tmp_path / "none"))
    assert log.read().count() == 0 and log.read().columns[0] == "item_id" and log.version() == -1 and log.compact() is None and log.vacuum() == []


def test_numbers_rise_and_snapshots_stay(spark, tmp_path):
    log = PartLog(spark, str(tmp_path / "log"))
    assert log.append(scores(spark, ["a", "b"])) == 0 and log.append(scores(spark, ["b", "c", "c"], 0.9)) == 1
    assert log.append(scores(spark, ["a"])) is None and log.version() == 1  # nothing new, no part
    assert ids(log.read()) == ["a", "b", "c"] and ids(log.read(0)) == ["a", "b"] and ids(log.read(after=0)) == ["c"]
    assert {r.item_id: r.score for r in log.read().collect()} == {"a": 0.5, "b": 0.5, "c": 0.9}
    assert log.compact() == 2 and ids(log.read()) == ["a", "b", "c"] and ids(log.read(0)) == ["a", "b"] and ids(log.read(after=1)) == []
    assert log._folders(-1, None) == [log.commits()[-1][1]["folder"]] and log.append(scores(spark, ["d"])) == 3 and ids(log.read()) == ["a", "b", "c", "d"]


def test_writers_at_once_lose_and_double_nothing(spark, tmp_path):
    log, done = PartLog(spark, str(tmp_path / "log")), []
    batches = [[f"i{n}" for n in range(k, k + 12)] for k in (0, 6, 12, 3)]
    work = [threading.Thread(target=lambda b=b: done.append(PartLog(spark, log.folder).append(scores(spark, b)))) for b in batches]
    for w in work:
        w.start()
    for w in work:
        w.join()
    numbers = sorted(n for n in done if n is not None)
    assert numbers == list(range(len(numbers))) and len(done) == 4
    assert ids(log.read()) == sorted({i for b in batches for i in b})
    assert sum(e["rows"] for _, e in log.commits()) == 24


def test_a_writer_that_is_overtaken_drops_what_is_there(spark, tmp_path, monkeypatch):
    log = PartLog(spark, str(tmp_path / "log"))
    other, put = PartLog(spark, log.folder), log._put

    def overtaken(number, text):
        monkeypatch.setattr(log, "_put", put)
        assert other.append(scores(spark, ["b", "x"], 0.9)) == 0
        return put(number, text)

    monkeypatch.setattr(log, "_put", overtaken)
    assert log.append(scores(spark, ["a", "b"])) == 1
    assert sorted((r.item_id, r.score) for r in log.read().collect()) == [("a", 0.5), ("b", 0.9), ("x", 0.9)]


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    log = PartLog(spark, str(tmp_path / "log"))
    log.append(scores(spark, ["a"]))
    dying = PartLog(spark, log.folder)
    monkeypatch.setattr(dying, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        dying.append(scores(spark, ["b"]))
    assert ids(log.read()) == ["a"] and log.vacuum(3600) == [] and len(log.vacuum(-1)) == 1 and ids(log.read()) == ["a"]
    assert log.append(scores(spark, ["b"])) == 1 and ids(log.read()) == ["a", "b"]


def test_older_parts_lack_columns(spark, tmp_path):
    log = PartLog(spark, str(tmp_path / "log"))
    log.append(scores(spark, ["a"]))
    name = log.commits()[0][1]["folder"]
    scores(spark, ["a"]).drop("load_s").write.mode("overwrite").parquet(f"{log.folder}/parts/{name}")
    log.append(scores(spark, ["b"]))
    assert {r.item_id: r.load_s for r in log.read().collect()} == {"a": None, "b": 0.1}


# --- cache --------------------------------------------------------------------------------------------------------
FIELDS = "item_id string, frame_index long, box double"


@pytest.fixture
def cache(spark, tmp_path):
    name = f"detections_{uuid.uuid4().hex}"
    make = lambda settings: DetectionCache(spark, name, str(tmp_path / "cache"), FIELDS, settings, buckets=4)
    yield make
    spark.sql(f"drop table if exists {name}")


def found(spark, names, box=1.0):
    return spark.createDataFrame([(i, k, box if k else None) for i in names for k in range(3)], FIELDS)


def test_restart_finds_what_is_left(spark, cache):
    first = cache({"size": 1, "model": "m"})
    assert settings_key({"model": "m", "size": 1}) == first.settings
    first.flush(found(spark, ["a", "b"]))
    items = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "item_id string")
    again = cache({"model": "m", "size": 1})
    assert {r.item_id for r in again.todo(items).collect()} == {"c", None}
    again.flush(found(spark, ["b", "c"], 9.0))  # b is there already
    assert sorted((r.item_id, r.frame_index, r.box) for r in again.load().where("frame_index > 0").collect()) == [(i, k, 9.0 if i == "c" else 1.0) for i in "abc" for k in (1, 2)]
    assert again.load().columns == ["item_id", "frame_index", "box"]


def test_settings_are_apart_and_replaced_apart(spark, cache):
    one, two = cache({"size": 1}), cache({"size": 2})
    one.flush(found(spark, ["a"]))
    two.flush(found(spark, ["a", "b"]))
    assert one.load().count() == 3 and two.load().count() == 6
    two.replace(found(spark, ["z"]))
    assert {r.item_id for r in two.load().collect()} == {"z"} and {r.item_id for r in one.load().collect()} == {"a"}


def test_the_cache_side_needs_no_exchange(spark, cache):
    one = cache({"size": 1})
    one.flush(found(spark, [f"i{n}" for n in range(50)]))
    items = spark.range(200).select(F.concat(F.lit("i"), F.col("id")).alias("item_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        todo = one.todo(items)
        shown = todo._jdf.queryExecution().executedPlan().toString()
        assert shown.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in shown and todo.count() == 150
        assert "PartitionFilters: [isnotnull(settings" in shown
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
