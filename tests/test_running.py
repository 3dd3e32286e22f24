"""Running energy from any split into batches against the energy of all samples at once."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import telemetry
from scoreloom.streaming.telemetry import running_energy

SCHEMA = "session_id long, ts timestamp, event_id long, watts double"


def samples(spark, n=300, seed=1):
    draw = random.Random(seed)
    rows = [(draw.choice([1, 1, 1, 2, 3]), 1_700_000_000 + draw.randint(0, 40_000), i, draw.uniform(0, 300)) for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, s long, event_id long, watts double").select("session_id", F.timestamp_seconds("s").alias("ts"), "event_id", "watts")


def run(spark, parts, folder, **more):
    """Each of ``parts`` is a file, and so a batch; to the updates in order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = running_energy(stream, **more).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return seen


@pytest.mark.parametrize("split", [1, 4])
def test_any_split_gives_the_same(spark, tmp_path, split):
    rows = samples(spark).cache()
    parts = [rows.where(F.col("event_id") % split == k) for k in range(split)]
    seen = run(spark, parts, tmp_path, lateness="20 hours", idle_s=10**7)
    last = {r.session_id: r for r in seen}
    for r in telemetry.energy(rows).collect():
        got = last[r.session_id]
        assert got.samples == r.samples and not got.ended
        assert (got.power_mean_w, got.power_max_w, got.energy_wh) == pytest.approx((r.power_mean_w, r.power_max_w, r.energy_wh))


def test_samples_behind_the_watermark_are_integrated_once(spark, tmp_path):
    rows = samples(spark, 240, 3).cache()
    bounds = [0, 9_000, 18_000, 27_000, 50_000]
    at = F.unix_seconds("ts") - 1_700_000_000
    parts = [rows.where((at >= a) & (at < b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    last = {r.session_id: r for r in run(spark, parts, tmp_path, lateness="10 minutes", idle_s=10**7)}
    for r in telemetry.energy(rows).collect():
        assert (last[r.session_id].samples, last[r.session_id].energy_wh) == (r.samples, pytest.approx(r.energy_wh))


def test_an_idle_session_ends(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, 1, 10.0), (1, 3600, 2, 20.0)], "session_id long, s long, event_id long, watts double")
    two = spark.createDataFrame([(2, 90_000, 3, 5.0), (2, None, 4, 1.0), (2, 90_001, 5, None)], "session_id long, s long, event_id long, watts double")
    parts = [p.select("session_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "event_id", "watts") for p in (one, two)]
    seen = run(spark, parts, tmp_path, lateness="1 minute", idle_s=3600)
    ended = [r for r in seen if r.ended]
    assert [(r.session_id, r.samples, r.energy_wh) for r in ended] == [(1, 2, pytest.approx(15.0))]
    assert [r.samples for r in seen if r.session_id == 2] == [1]
