"""Draws by hash: all replicates of the registered query, and classes of several blocks against plain code."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scoreloom.operators import draws, metrics

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def head(text):
    return int(hashlib.sha1(text.encode()).hexdigest()[:8], 16)


def test_bootstrap_hash_has_the_reference_s_thousand_replicates(spark):
    got = entry.queries()["bootstrap_hash"](spark, SF).collect()
    assert sorted(r.replicate for r in got) == list(range(1000)) and len({r.auc for r in got}) > 900


def test_heads_of_sha1():
    for first, last in ((0, 10), (10, 100), (99_990, 100_000), (10**12, 10**12 + 5)):
        assert draws.heads(b"-7:12:1:", np.arange(first, last)).tolist() == [head(f"-7:12:1:{k}") for k in range(first, last)]
    with pytest.raises(ValueError, match="55"):
        draws.heads(b"0" * 50, np.arange(10**6, 10**6 + 2))


def plain(items, replicate, seed):
    """AUC and EER of one replicate of (item_id, y, score)."""
    drawn = {}
    for y in (0, 1):
        ids = sorted((hashlib.sha1(i.encode()).hexdigest(), s) for i, label, s in items if label == y)
        drawn[y] = np.array([ids[head(f"{seed}:{replicate}:{y}:{k}") % len(ids)][1] for k in range(len(ids))])
    real, fake = np.sort(drawn[0]), np.sort(drawn[1])
    auc = (np.searchsorted(real, fake, "left") + np.searchsorted(real, fake, "right")).sum() / (2 * len(real) * len(fake))
    down = np.unique(np.concatenate([real, fake]))[::-1]
    fpr, tpr = (np.concatenate([[0], 1 - np.searchsorted(x, down, "left") / len(x)]) for x in (real, fake))
    gap = 1 - tpr - fpr
    at = int(np.flatnonzero(gap <= 0)[0])
    return auc, fpr[at - 1] + gap[at - 1] / (gap[at - 1] - gap[at]) * (fpr[at] - fpr[at - 1])


def test_classes_of_several_blocks_and_ranges(spark):
    n = 75_000
    assert n * 4 // 7 > draws.DRAWS > 2 * draws.BLOCK - 1
    y = [int(i % 7 < 4) for i in range(n)]
    s = [round((i * 7919 % 10_007) / 10_007 + 0.1 * a, 2 if i % 3 else 9) for i, a in enumerate(y)]  # many equal, many not
    rows = spark.createDataFrame([(f"i{i}", "fake" if a else "real", x, "ok") for i, (a, x) in enumerate(zip(y, s, strict=True))], "item_id string, label string, score double, status string")
    got = {r.replicate: (r.auc, r.eer) for r in metrics.hash_bootstrap(rows, 3, seed=5).collect()}
    items = [(f"i{i}", a, x) for i, (a, x) in enumerate(zip(y, s, strict=True))]
    assert sorted(got) == [0, 1, 2]
    for r, found in got.items():
        assert found == pytest.approx(plain(items, r, 5), abs=1e-12)


def test_no_replicates_without_both_classes(spark):
    rows = spark.range(50).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("real").alias("label"), F.col("id").cast("double").alias("score"), F.lit("ok").alias("status"))
    assert metrics.hash_bootstrap(rows, 4).count() == 0 == metrics.hash_bootstrap(rows.where("false"), 4).count()
