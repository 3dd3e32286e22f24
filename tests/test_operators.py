"""Known answers and invariants of the evaluation operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import scalar
from scoreloom.operators import evalset, frames, lineage, manifest, metrics, roc, sampling, scoring, shortcut, splits, status, telemetry
from scoreloom.sources import readers, sinks
from scoreloom.streaming.scores import score_stream
from scoreloom.plans import reporting


def scored(spark, labels, scores, **more):
    rows = [(f"x/{i}", {"r": "real", "f": "fake"}[y], s, "ok") for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "item_id string, label string, score double, status string")


def summary(spark, labels, scores, **more):
    return metrics.summary(scored(spark, labels, scores), **more).first()


def test_perfect_and_reversed_scores(spark):
    r = summary(spark, "rrff", [0.1, 0.2, 0.8, 0.9])
    assert r.auc == 1 and r.eer == 0 and 0.2 < r.threshold <= 0.8 and r.ap == 1
    assert metrics.direction_ok(scored(spark, "rrff", [0.1, 0.2, 0.8, 0.9])).first()[0]
    assert not metrics.direction_ok(scored(spark, "rrff", [0.9, 0.8, 0.2, 0.1])).first()[0]
    assert not metrics.direction_ok(scored(spark, "ff", [0.9, 0.8])).first()[0]


def test_equal_error_rate(spark):
    assert summary(spark, "rrrrffff", [0.1, 0.2, 0.3, 0.7, 0.6, 0.8, 0.9, 0.95]).eer == pytest.approx(0.25)
    r = summary(spark, "fff", [0.1, 0.2, 0.3])
    assert r.auc is None and r.eer is None and r.n_fake == 3 and r.n_real == 0


def test_rates_and_accuracy(spark):
    df = scored(spark, "rrff", [0.1, 0.6, 0.4, 0.9]).withColumns({"threshold": F.lit(0.5), "g": F.lit(0)})
    r = metrics.at_threshold(df, ["g"]).first()
    assert (r.fpr, r.fnr) == (0.5, 0.5)
    df = scored(spark, "rrrf", [0.1, 0.2, 0.7, 0.9]).withColumns({"threshold": F.lit(0.5), "g": F.lit(0)})
    r = metrics.at_threshold(df, ["g"]).first()
    assert r.acc == 0.75 and r.bal_acc == pytest.approx((2 / 3 + 1) / 2)
    df = scored(spark, "ff", [0.1, 0.9]).withColumns({"threshold": F.lit(0.5), "g": F.lit(0)})
    r = metrics.at_threshold(df, ["g"]).first()
    assert r.fpr is None and r.fnr == 0.5 and r.bal_acc == 0.5


def test_rate_at_fixed_false_positives(spark):
    r = summary(spark, "r" * 10 + "f" * 10, [i / 100 for i in range(9)] + [0.5] + [0.4, 0.41, 0.42, 0.43] + [0.6] * 6, targets=(0.05, 0.1))
    assert r.tpr_at_fpr05 == pytest.approx(0.6) and r.tpr_at_fpr10 == 1


def slow_curve(y, s):
    """Vertices by the definition: a point for each distinct score, without those in a line with both neighbours."""
    thr = sorted(set(s), reverse=True)
    pts = [(sum(b >= t and not a for a, b in zip(y, s, strict=True)), sum(b >= t and a for a, b in zip(y, s, strict=True)), t) for t in thr]
    keep = [p for i, p in enumerate(pts) if i in (0, len(pts) - 1) or any(pts[i + 1][k] - 2 * p[k] + pts[i - 1][k] for k in (0, 1))]
    n, p = len(y) - sum(y), sum(y)
    return sorted([(0.0, 0.0, None)] + [(round(f / n, 9), round(t / p, 9), x) for f, t, x in keep], key=str)


def test_curve_equals_definition_across_bands(spark):
    rnd = random.Random(1)
    for spread in (3, 40, 5000):
        y = [rnd.randint(0, 1) for _ in range(300)]
        s = [round(rnd.randint(0, spread) / spread + 0.2 * a, 9) for a in y]
        df = spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double").withColumn("g", F.lit(None).cast("string"))
        got = sorted(((round(r.fpr, 9), round(r.tpr, 9), r.threshold) for r in roc.curve(df, ["g"]).collect()), key=str)
        assert got == slow_curve(y, s)
        a = roc.areas(df, ["g"]).first().auc
        pairs = [(1.0 if f > r else 0.5 if f == r else 0.0) for f, yf in zip(s, y, strict=True) if yf for r, yr in zip(s, y, strict=True) if not yr]
        assert a == pytest.approx(np.mean(pairs))


def test_groups_keep_failures_and_nulls(spark):
    rows = [(f"x/{i}", "fake" if i % 2 else "real", 0.9 if i % 2 else 0.1, "ok", "f") for i in range(80)] + [(f"y/{i}", "real", None, "no_face", None) for i in range(2)]
    df = spark.createDataFrame(rows, "item_id string, label string, score double, status string, g_gender string")
    got = {r["group"]: r for r in metrics.per_group(df, "g_gender").collect()}
    assert got["f"].auc == 1 and not got["f"].small and got["<null>"].n_failed == 2 and got["<null>"].small and got["<null>"].auc is None


def test_bootstraps_bracket_the_estimate(spark):
    rnd = np.random.default_rng(0)
    labels = "rf" * 150
    df = scored(spark, labels, [float(x) for x in rnd.normal(0, 1, 300) + np.array([c == "f" for c in labels])]).withColumn("g", F.lit("a"))
    auc = metrics.summary(df).first().auc
    r = metrics.exact_bootstrap(df, "g", n=200).first()
    assert r.auc_lo < auc < r.auc_hi and r.auc_hi - r.auc_lo < 0.2
    h = [x.auc for x in metrics.hash_bootstrap(df, 20).collect()]
    assert len(h) == 20 and min(h) < auc < max(h)


def test_evalset_errors_and_subset(spark):
    rows = [(f"d/{i}", "real" if i < 30 else "fake", "real" if i < 30 else "swap" if i < 50 else "rare") for i in range(53)]
    df = spark.createDataFrame(rows, "item_id string, label string, method string")
    with pytest.raises(evalset.EvalsetError):
        evalset.apply_filter(df, {"nope": 1})
    with pytest.raises(evalset.EvalsetError):
        evalset.relabel(df, "from_video")
    five = evalset.subset(df, 5, ["method"])
    assert {r.method: r["count"] for r in five.groupBy("method").count().collect()} == {"rare": 3, "real": 5, "swap": 5}
    ids = lambda d: {r.item_id for r in d.collect()}
    assert ids(five) == ids(evalset.subset(df.orderBy(F.rand(1)), 5, ["method"])) <= ids(evalset.subset(df, 8, ["method"]))
    assert ids(five) != ids(evalset.subset(df, 5, ["method"], seed=1))
    assert sum(sampling.shards(df, 4).groupBy("shard").count().toPandas()["count"]) == 53
    assert sampling.pick_balanced(df, 50).groupBy("label").count().where("label = 'fake'").first()["count"] == 23
    with pytest.raises(Exception, match="null"):
        evalset.relabel(df.withColumn("label_audio", F.lit(None).cast("string")), "from_audio").collect()


def test_manifest_reports_every_problem(spark, tmp_path):
    good = spark.createDataFrame([("d/1", "d", "1.wav", "audio", "real", "f", "dataset")], "item_id string, dataset string, rel_path string, modality string, label string, g_gender string, g_gender_src string")
    assert manifest.problems(good, "d").count() == 0
    bad = good.withColumn("label", F.lit("maybe")).withColumn("g_gender", F.lit("Unknown")).withColumn("gender", F.lit(1)).drop("g_gender_src")
    text = " | ".join(r.problem for r in manifest.problems(bad.union(bad), "d").collect())
    for part in ("real or fake", "unique", "needs a g_gender_src", "g_ prefix"):
        assert part in text
    assert any("placeholder" in r.problem for r in manifest.problems(good.withColumn("g_gender", F.lit("Unknown")), "d").collect())
    for label, video, audio in (("real", "fake", "real"), ("fake", "real", "real"), ("real", "maybe", None)):
        df = good.withColumns({"label": F.lit(label), "label_video": F.lit(video), "label_audio": F.lit(audio).cast("string")})
        assert any("track" in r.problem for r in manifest.problems(df, "d").collect())
    manifest.write(good, "d", str(tmp_path / "m"))
    assert readers.read_manifest(spark, str(tmp_path / "m")).count() == 1
    with pytest.raises(ValueError, match="unique"):
        manifest.write(good.union(good), "d", str(tmp_path / "m2"))
    a, b = (manifest.wide_hash(d).first() for d in (good.union(good.withColumn("item_id", F.lit("d/2"))), good.withColumn("item_id", F.lit("d/2")).union(good)))
    assert a == b


def test_closure_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "node string, parent string")
    got = {(r.source, r.node) for r in lineage.closure(nodes, edges).collect()}
    assert got == {(s, n) for s in "abc" for n in "abc"} | {("d", n) for n in "abcd"}


def frame_rows(spark, boxes):
    return spark.createDataFrame([("i", k, b) for k, b in enumerate(boxes)], "item_id string, frame_index int, box double")


def test_fills_and_smoothing(spark):
    df = frame_rows(spark, [None, 1.0, None, 4.0])
    assert [r.filled for r in frames.fill_nearest(df).orderBy("frame_index").collect()] == [1, 1, 1, 4]
    assert [r.filled for r in frames.forward_fill(df).orderBy("frame_index").collect()] == [1, 1, 1, 4]
    assert frames.fill_nearest(frame_rows(spark, [None, None])).count() == 0
    track = frame_rows(spark, [20.0] * 9 + [60.0] + [20.0] * 10)
    assert [r.smooth for r in frames.median_smooth(track, "box").collect()] == [20.0] * 20
    assert [r["mean"] for r in frames.sliding_mean(frame_rows(spark, [1.0, 2.0, 3.0, 7.0]), "box", 3).orderBy("frame_index").collect()] == [2, 4, 4, 4]


def test_windows_and_sampling(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    n = lambda v: F.lit(v).cast("int")
    assert get(frames.segment_starts(n(20_000), 64_600, 16_000)) == [0]
    assert get(frames.segment_starts(n(150_000), 64_600, 16_000)) == [0, 64_600, 85_400]
    assert get(frames.segment_starts(n(129_200), 64_600, 16_000)) == [0, 64_600]
    assert get(frames.segment_starts(n(100), 64_600, 16_000)) is None
    assert get(frames.window_frames(n(5), 10, 5)) == []
    w = get(frames.window_frames(n(100), 10, 5))
    assert len(w) == 50 and w[0] == 0 and w[-1] == 98
    assert get(frames.spread_frames(n(3), 8)) == [0, 1, 2] and get(frames.spread_frames(n(0), 8)) == []
    clips = get(frames.clip_windows(n(8), 10, 3))
    inner = list(range(8))
    post = (inner[1:-1][::-1] + inner)[:9]
    pre = (inner + inner[1:-1][::-1])[-9:]
    padded = pre + inner + post
    assert clips == [padded[s : s + 10] for s in range(0, len(padded) - 9, 3)]
    assert get(frames.clip_windows(n(12), 10, 2)) == [list(range(10)), list(range(2, 12))]


def test_clips_come_from_their_starts(spark):
    """Tracks of any size against padded lists, and no slice of a whole track for each window."""
    lengths = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 8, 24, 25, 26, 60)], "n int")
    made = lengths.select("n", F.posexplode(frames.clip_starts(F.col("n"), 25, 5)).alias("clip", "start")).withColumn("x", frames.clip_at(F.col("n"), F.col("start"), 25))
    got = {}
    for r in made.orderBy("n", "clip").collect():
        got.setdefault(r.n, []).append(r.x)
    for n in (1, 2, 3, 8, 24, 25, 26, 60):
        inner = list(range(n))
        mid = inner[1:-1][::-1]
        track = inner if n >= 25 else ((inner + mid) * 24)[-24:] + inner + ((mid + inner) * 24)[:24]
        assert got.pop(n) == [track[s : s + 25] for s in range(0, len(track) - 24, 5)]
    assert not got
    shown = reporting.clip_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "slice(" not in shown and "REPARTITION_BY_NUM" in shown


def test_suppression_keeps_the_best(spark):
    boxes = spark.createDataFrame([(0.9, 0, 0.0, 0.0, 9.0, 9.0), (0.8, 1, 1.0, 1.0, 10.0, 10.0), (0.7, 2, 50.0, 50.0, 60.0, 60.0)], "score double, idx int, x1 double, y1 double, x2 double, y2 double")
    got = boxes.agg(F.collect_list(F.struct("*")).alias("b")).select(frames.nms(F.col("b"), 0.4).alias("k")).first().k
    assert got == [0, 2]


def test_energy_and_rollup(spark):
    rows = spark.createDataFrame([(1, "1970-01-01 00:00:00", 1, "click", 100.0), (1, "1970-01-01 01:00:00", 2, "view", 300.0)], "session_id long, ts string, event_id long, phase string, watts double").withColumn("ts", F.to_timestamp("ts"))
    assert telemetry.energy(rows).first().energy_wh == pytest.approx(200)
    s = telemetry.sessions(rows).withColumn("energy_wh", F.lit(4.0))
    r = telemetry.roll_up(s.union(s), "click").first()
    assert r.sessions == 2 and r.items_per_s == pytest.approx(4 / 200) and r.energy_wh_per_1k_items == pytest.approx(2000)
    assert telemetry.roll_up(s, "none").first().items_per_s is None
    p = spark.createDataFrame([(1.0, 1.0005), (2.0, 2.0)], "adapter double, reference double")
    assert telemetry.parity(p, 1e-3).first().passed and not telemetry.parity(p.limit(0), 1e-3).first().passed


def test_no_identity_spans_splits(spark):
    rnd = random.Random(3)
    rows = [(f"d/{i}", f"s{rnd.randint(0, 29)}", f"s{rnd.randint(0, 29)}" if i % 15 == 0 else None) for i in range(120)] + [(f"n/{i}", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, subject_id string, source_subject_id string")
    fractions = {"train": 0.7, "val": 0.1, "test": 0.2}
    got = {r.item_id: r.split for r in splits.identity_split(df, fractions, seed=3).collect()}
    where = {}
    for item, *ids in rows:
        for x in filter(None, ids):
            assert where.setdefault(x, got[item]) == got[item]
    assert len(got) == 420 and abs(sum(v == "train" for v in got.values()) / 420 - 0.7) < 0.12
    assert got == {r.item_id: r.split for r in splits.identity_split(df.repartition(5), fractions, seed=3).collect()}
    chain = spark.createDataFrame([(f"c/{i}", f"p{i:03}", f"p{i + 1:03}") for i in range(150)], "item_id string, subject_id string, source_subject_id string")
    assert splits.identity_components(chain).select("component").distinct().count() == 1


def test_runs_are_dealt_as_one_by_one():
    rnd = random.Random(8)
    for _ in range(60):
        names = [f"s{i}" for i in range(rnd.randint(1, 4))]
        cuts = [rnd.randint(1, 9) for _ in names]
        share = {s: 500 * c / sum(cuts) for s, c in zip(names, cuts, strict=True)}
        have = {s: float(rnd.randint(0, 60)) for s in names}
        n, size = rnd.randint(1, 40), rnd.randint(1, 7)
        slow, now = dict.fromkeys(names, 0), dict(have)
        for _ in range(n):
            s = max(names, key=lambda s: (share[s] - now[s]) / share[s])
            now[s] += size
            slow[s] += 1
        assert splits.dealt(n, size, have, share) == slow


def test_split_shares_are_met(spark):
    rows = [(f"d/{i}", f"s{i // 7}" if i < 700 else None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "item_id string, subject_id string, source_subject_id string")
    got = splits.identity_split(df, {"train": 0.7, "val": 0.1, "test": 0.2}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2100, "val": 300, "test": 600}


def test_clip_features():
    t = np.arange(16_000) / 16_000
    f = dict(zip(shortcut.FEATURES, shortcut.clip_features(np.concatenate([0.5 * np.sin(2 * np.pi * 440 * t), np.zeros(16_000)]), 16_000, 44_100), strict=True))
    assert f["duration_s"] == 2 and -12.5 < f["rms_db"] < -11.5 and 0.4 < f["silence_ratio"] < 0.6 and 300 < f["spectral_rolloff_hz"] < 600 and f["spectral_bandwidth_hz"] < 200
    assert shortcut.clip_features(np.zeros(100), 16_000, 8_000)[1] == -120


def test_probe_finds_a_planted_feature(spark):
    rnd = np.random.default_rng(1)
    rows = [(f"x/{i}", "fake" if i % 2 else "real", float(i % 2) + float(rnd.normal(0, 0.05)), float(rnd.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id string, label string, rate double, noise double")
    p = shortcut.probe(df, ["rate", "noise"]).select(F.col("y").cast("int").alias("y"), "s", F.lit(0).alias("g"))
    assert roc.areas(p, ["g"]).first().auc > 0.99
    a = {r.feature: r.auc for r in shortcut.feature_aucs(df, ["rate", "noise"]).collect()}
    assert a["rate"] == 1 and a["noise"] < 0.65


def test_parts_resume_and_guard(spark, tmp_path):
    out = tmp_path / "scores"
    items = spark.createDataFrame([(f"d/{i}", float(i)) for i in range(10)], "item_id string, x double")
    score = lambda df: df.select("item_id", F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("n_windows"), F.lit("ok").alias("status"))
    sinks.append_scores(score(items.limit(4)), str(out))
    assert readers.read_scores(spark, str(out)).where("load_s is null").count() == 4
    left = sinks.resume(items, str(out))
    assert left.count() == 6
    sinks.append_scores(score(left), str(out))
    assert sinks.resume(items, str(out)).count() == 0
    with pytest.raises(PermissionError):
        sinks.write_groups(items, str(tmp_path / "g"))
    sinks.write_groups(items.select("x").limit(1), str(tmp_path / "g"))


def test_stream_adds_nothing_twice(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    items = spark.createDataFrame([(f"d/{i}",) for i in range(10)], "item_id string")
    score = lambda df: df.select("item_id", F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("n_windows"), F.lit("ok").alias("status"))
    sinks.append_scores(score(items.limit(3)), str(out))
    for k in range(2):
        items.write.mode("append").parquet(str(src))
        score_stream(spark, str(src), "item_id string", str(out), str(tmp_path / f"c{k}"), score).awaitTermination()
    assert readers.read_scores(spark, str(out)).count() == 10


def test_latest_run_and_refusal(spark):
    rows = [("a", "m", "e", "2026-01-01", 1, None, "eval", "h"), ("b", "m", "e", "2026-01-01", 0, None, "eval", "h"), ("c", "m", "e", "2025-01-01", 0, None, "eval", "h"), ("d", "m", "t", "2026-01-01", 0, None, "pipeline_test", "h")]
    runs = spark.createDataFrame(rows, "run_id string, model string, evalset string, started string, source_rank int, namespace string, role string, config_hash string")
    assert [r.run_id for r in status.latest_runs(runs).collect()] == ["b"]


def test_scorer_plugin_keeps_failures(spark):
    class Half(scoring.Scorer):
        def score(self, inputs):
            return inputs * 0 + 0.5

    df = spark.createDataFrame([("a", 1.0), ("b", None)], "item_id string, x double")
    assert {tuple(r) for r in scoring.run_scorer(df, Half(), "x").collect()} == {("a", 0.5, "ok"), ("b", None, "unreadable")}


def test_loader_plugin_says_why(spark):
    class Track(scoring.Loader):
        columns = ("samples", "rate")

        def load(self, rows):
            status = rows["samples"].map(lambda x: "no_audio" if x is None else "too_short" if len(x) < 2 else "ok")
            return rows["samples"].where(status == "ok"), status

    class Mean(scoring.Scorer):
        def score(self, inputs):
            return inputs.map(lambda x: float(sum(x) / len(x)))

    df = spark.createDataFrame([("a", [0.25, 0.75], 8), ("b", [1.0], 8), ("c", None, 8)], "item_id string, samples array<double>, rate int")
    got = {tuple(r) for r in scoring.run_scorer(df, Mean(), Track()).collect()}
    assert got == {("a", 0.5, "ok"), ("b", None, "too_short"), ("c", None, "no_audio")}


def test_globs():
    import re

    assert re.search(scalar.glob_pattern("fake/*/a[!b].w?v"), "fake/x/y/ac.wav") and not re.search(scalar.glob_pattern("fake/*.wav"), "fake/a.wav.txt")
    assert scalar.literal_folder("fake/si/*") == "fake/si" and scalar.literal_folder("*.wav") == ""
