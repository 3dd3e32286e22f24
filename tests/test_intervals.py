"""Bootstrap intervals against plain versions."""

import numpy as np
import pytest

from scoreloom.operators import intervals, metrics


def slow_values(y, s, w):
    """Area and equal error rate of one weighted replicate, pair by pair and point by point."""
    fakes, reals = [(s[i], w[i]) for i in range(len(s)) if y[i]], [(s[i], w[i]) for i in range(len(s)) if not y[i]]
    p, n = sum(k for _, k in fakes), sum(k for _, k in reals)
    if not p or not n:
        return None
    area = sum(a * b * ((u > v) + (u == v) / 2) for u, a in fakes for v, b in reals) / (p * n)
    before = (0.0, 0.0)
    for t in sorted(set(s), reverse=True):
        now = (sum(k for u, k in fakes if u >= t) / p, sum(k for u, k in reals if u >= t) / n)
        d0, d1 = 1 - sum(before), 1 - sum(now)
        if d1 <= 0:
            return area, before[1] + d0 / (d0 - d1) * (now[1] - before[1])
        before = now
    raise AssertionError


def test_weights_are_poisson():
    def slow(x0, r):
        p, (a, b, c) = intervals.PRIME, intervals.STEPS
        x = (x0 * a + r * b + 1) % p
        x = (x * x + x0) % p
        x = (x * c + r) % p
        return int(np.searchsorted(intervals.POISSON, (x * x + 7) % p / p, side="right"))

    begin = np.random.default_rng(3).integers(0, 2**28, 70)
    assert [[slow(int(x), r) for r in range(0, 1000, 9)] for x in begin] == intervals.weights(begin, np.arange(0, 1000, 9)).tolist()
    w = intervals.weights(np.random.default_rng(1).integers(0, 2**28, 3000), np.arange(200))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


@pytest.mark.parametrize("block", [1_024, 3])
def test_replicates_equal_pair_by_pair(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rnd = np.random.default_rng(2)
    rows = [(f"i/{i}", "ab"[i % 2] if i % 7 else None, "fake" if rnd.random() < 0.5 else "real", float(rnd.integers(0, 9)) / 8, "ok") for i in range(90)]
    rows += [("lone", "c", "real", 0.5, "ok"), ("bad", "a", "fake", None, "error"), *((f"t/{i}", "t", ("real", "fake")[i % 2], 0.5, "ok") for i in range(8))]
    df = spark.createDataFrame(rows, "item_id string, g string, label string, score double, status string").repartition(4)
    got = {(r.grp, r.r): (r.auc, r.eer) for r in intervals.replicate_values(df, "g", 20).collect()}
    start = {r.item_id: r.x for r in df.select("item_id", intervals.start("item_id").alias("x")).collect()}
    expect = {}
    for name in ("a", "b", "<null>", "c", "t"):
        own = [r for r in rows if (r[1] or "<null>") == name and r[4] == "ok"]
        w = intervals.weights(np.array([start[r[0]] for r in own]), np.arange(20)).astype(int)
        for k in range(20):
            if value := slow_values([r[2] == "fake" for r in own], [r[3] for r in own], w[:, k]):
                expect[name, k] = value
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k]) for k in expect)
    ends = {r.grp: r for r in intervals.intervals(df, "g", 20).collect()}
    assert "c" not in ends
    areas = [v[0] for (g, _), v in expect.items() if g == "a"]
    assert (ends["a"].auc_lo, ends["a"].auc_hi) == pytest.approx(tuple(np.quantile(areas, [0.025, 0.975])))
    assert intervals.intervals(df.limit(0), "g", 5).count() == 0


def slow_metrics(y, s, w):
    """Average precision and rates within 1 % and 30 % of the reals, threshold by threshold."""
    p, n = sum(k for k, f in zip(w, y, strict=True) if f), sum(k for k, f in zip(w, y, strict=True) if not f)
    if not p or not n:
        return None
    ap, best, last = 0.0, {0.01: 0.0, 0.3: 0.0}, 0
    for t in sorted(set(s), reverse=True):
        tp, fp = (sum(k for k, f, v in zip(w, y, s, strict=True) if f == c and v >= t) for c in (True, False))
        ap += (tp - last) / p * (tp / (tp + fp) if tp + fp else 0)
        last = tp
        best = {k: max(v, tp / p) if fp / n <= k else v for k, v in best.items()}
    return ap, *best.values()


@pytest.mark.parametrize("scores", ["constant", "two", "many"])
@pytest.mark.parametrize("range_rows", [4, 1 << 16])
def test_any_metric_and_tied_scores(spark, monkeypatch, scores, range_rows):
    """A constant scorer, one of zeros and ones, and one of few ties, in many ranges and in few."""
    monkeypatch.setattr(intervals, "RANGE_ROWS", range_rows)
    rnd = np.random.default_rng(5)
    draw = {"constant": lambda: 0.25, "two": lambda: float(rnd.integers(0, 2)), "many": lambda: float(rnd.integers(0, 40)) / 8}[scores]
    rows = [(f"i/{i}", "ab"[i % 5 == 0], "fake" if rnd.random() < 0.6 else "real", draw(), "ok") for i in range(120)]
    df = spark.createDataFrame(rows, "item_id string, g string, label string, score double, status string").repartition(4)
    metrics = {"ap": intervals.METRICS["ap"], "t01": intervals.tpr_within(0.01), "t30": intervals.tpr_within(0.3), "auc": intervals.METRICS["auc"], "eer": intervals.METRICS["eer"]}
    got = {(r.grp, r.r): tuple(r)[2:] for r in intervals.metric_values(df, "g", metrics, 12).collect()}
    fixed = {(r.grp, r.r): (r.auc, r.eer) for r in intervals.replicate_values(df, "g", 12).collect()}
    start = {r.item_id: r.x for r in df.select("item_id", intervals.start("item_id").alias("x")).collect()}
    for name in "ab":
        own = [r for r in rows if r[1] == name]
        w = intervals.weights(np.array([start[r[0]] for r in own]), np.arange(12)).astype(int)
        y, s = [r[2] == "fake" for r in own], [r[3] for r in own]
        for k in range(12):
            assert got[name, k] == pytest.approx((*slow_metrics(y, s, w[:, k]), *slow_values(y, s, w[:, k])))
            assert fixed[name, k] == pytest.approx(slow_values(y, s, w[:, k]))
    parts = intervals._segments(df, "g", 2, "item_id")[0].groupBy("part").count().agg({"count": "max"}).first()[0]
    assert range_rows > 4 or parts < 40  # even a constant score is spread over ranges
    ends = intervals.metric_intervals(df, "g", {"ap": metrics["ap"]}, 12).collect()
    assert {r.grp for r in ends} == {"a", "b"} and all(r.ap_lo <= r.ap_hi for r in ends)


def test_seeded_intervals_equal_resample_by_resample(spark):
    rnd = np.random.default_rng(9)
    rows = [(f"i/{i:03}", "ab"[i % 4 == 0], "fake" if rnd.random() < 0.5 else "real", float(rnd.integers(0, 12)) / 8, "ok") for i in range(60)] + [("x", "c", "real", 0.1, "ok")]
    df = spark.createDataFrame(rows, "item_id string, g string, label string, score double, status string").repartition(3)
    got = {r.g: tuple(r)[1:] for r in metrics.exact_bootstrap(df, "g", 40, seed=3).collect()}
    for name in "ab":
        own = [r for r in rows if r[1] == name]
        y, s = np.array([r[2] == "fake" for r in own]), [r[3] for r in own]
        gen, values = np.random.default_rng(3), []
        for _ in range(40):
            w = np.zeros(len(own), int)
            for side in (False, True):
                members = np.flatnonzero(y == side)
                np.add.at(w, gen.choice(members, len(members)), 1)
            values.append(slow_values(y, s, w))
        assert got[name] == pytest.approx(np.quantile(np.array(values), [0.025, 0.975], axis=0).T.ravel())
    assert got["c"] == (None, None, None, None)
