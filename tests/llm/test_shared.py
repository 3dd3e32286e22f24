import os
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from scoreloom.llm import shared


def test_clean_removes_only_old_folders_of_its_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    names = [f"media-{uuid.uuid4().hex}", f"pipeline-{uuid.uuid4().hex}", f"other-{uuid.uuid4().hex}", "media-mine"]
    for n in names:
        (tmp_path / n / "part").mkdir(parents=True)
    assert shared.clean(spark) == []
    for n in names:
        os.utime(Path(tmp_path) / n, (0, 0))
    assert shared.clean(spark, kinds=("media",)) == [names[0]]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names[1:])


def test_numbered_follows_the_order_over_ranges(spark):
    rows = [(None if i % 5 == 0 else i % 37, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a long, b long").withColumn("part", F.lit("clash")).repartition(7)
    got = shared.numbered(frame, [F.col("a").asc_nulls_last(), F.col("b").desc()], "n").collect()
    expect = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == expect and sorted(r.n for r in got) == list(range(3000))
    assert got[0]["part"] == "clash" and shared.numbered(frame.limit(0), [F.col("a")], "n").count() == 0


def test_free_names(spark):
    frame = spark.range(1).withColumns({"part": F.lit(0), "Part_": F.lit(0)})
    assert shared.free_names(frame, "part", "part", "x") == ["part__", "part___", "x"]
