"""Order statistics against percentile and sorting, with spans that are refined again and again; samples against plain code."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import quantiles, sampling, telemetry

QS = {"q0": 0.0, "q1": 0.01, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def values(seed=2):
    draw = random.Random(seed)
    rows = [("even", float(i)) for i in range(500)] + [("tied", float(draw.randint(0, 3))) for _ in range(400)] + [("one", 5.0)] * 300
    rows += [("steep", 10.0 ** draw.uniform(-300, 300) * draw.choice([-1, 1])) for _ in range(400)] + [("huge", x) for x in (-1.7e308, 1.7e308, 0.0, 1.0, -5e-324) for _ in range(30)]
    rows += [(None, draw.gauss(0, 1)) for _ in range(300)] + [("few", 3.0), ("few", 1.0)] + [("even", None), ("void", None), ("few", float("nan"))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [1, 7, 1 << 16])
def test_quantiles_equal_percentile(spark, small):
    rows = spark.createDataFrame(values(), "g string, v double")
    got = {r.g: tuple(r)[1:] for r in quantiles.exact_quantiles(rows, ["g"], F.col("v"), QS, small).collect()}
    ok = rows.where("v is not null and not isnan(v)")
    want = {r.g: tuple(r)[1:] for r in ok.groupBy("g").agg(*(F.percentile("v", q).alias(n) for n, q in QS.items())).collect()}
    assert got == want and set(got) == {"even", "tied", "one", "steep", "huge", None, "few"}
    assert quantiles.exact_quantiles(rows.limit(0), ["g"], F.col("v"), QS, small).count() == 0
    whole = quantiles.exact_quantiles(rows, [], F.col("v"), {"m": 0.5}, small).collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in ok.agg(F.percentile("v", 0.5)).collect()]
    with pytest.raises(ValueError, match="quantiles"):
        quantiles.exact_quantiles(rows, ["g"], F.col("v"), {"x": 1.5})


def test_bins_keep_the_order(spark):
    draw = random.Random(4)
    for lo, hi in ((-1.7e308, 1.7e308), (1.0, 1.0 + 2**-50), (-5e-324, 5e-324), (0.0, 1e-310)):
        xs = sorted({lo, hi, *(min(hi, max(lo, lo + (hi / 2 - lo / 2) * draw.random() * 2)) for _ in range(200))})
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, v double")
        bins = [r.b for r in frame.select("i", quantiles._bin(F.col("v"), F.lit(lo), F.lit(hi)).alias("b")).orderBy("i").collect()]
        assert bins == sorted(bins) and bins[0] == 0 and bins[-1] == quantiles.BINS - 1


def test_rows_of_a_large_group_do_not_shuffle(spark):
    """One group of many rows: no task reads more rows after a shuffle than there are bins for each task before it."""
    rows = spark.range(0, 200_000, numPartitions=8).select(F.lit("g").alias("k0"), F.sin("id").alias("v"))
    got = quantiles.exact_quantiles(rows, ["k0"], F.col("v"), {"m": 0.5, "p": 0.99}, 1_000).first()
    want = rows.agg(F.percentile("v", 0.5), F.percentile("v", 0.99)).first()
    assert tuple(got)[1:] == tuple(want)


def test_timing_and_profile(spark):
    rows = spark.createDataFrame([(None, 0.5, 2.0), (None, 1.0, None), ("a", None, 1.0), ("a", 0.25, 0.0), ("b", None, None)], "g string, s double, u double")
    assert sorted(map(repr, map(tuple, telemetry.timing(rows, "s", ["g"]).collect()))) == sorted(map(repr, [(None, 750.0, 750.0, 975.0), ("a", 250.0, 250.0, 250.0), ("b", None, None, None)]))
    assert sorted(map(repr, map(tuple, telemetry.profile(rows, "g", "s", "u").collect()))) == sorted(map(repr, [(None, 750.0, 250.0, 2.0), ("a", 250.0, None, 0.5), ("b", None, None, None)]))


def rank(seed, key):
    return hashlib.sha1(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("small", [5, 1 << 16])
def test_first_by_hash(spark, small):
    draw = random.Random(3)
    rows = [(f"i{n}", draw.choice(["hot"] * 8 + ["a", "b", None])) for n in range(600)] + [("same", "hot")] * 40
    frame = spark.createDataFrame(rows, "item_id string, s string").withColumns({"k": F.lit("clash"), "n": F.lit(1), "last": F.lit(2), "below": F.lit(3)})
    for cap in (0, 1, 10, 10_000):
        got = sampling._among_first(frame.drop("k", "n", "last", "below"), cap, ["s"], 7, "item_id", small).collect()
        want = {s: sorted((i for i, t in rows if t == s), key=lambda i: (rank(7, i), i))[:cap] for s in {t for _, t in rows}}
        assert len(got) == len(rows)
        for s, first in want.items():
            assert sorted(r.item_id for r in got if r.s == s and r._first) == sorted(first)
    marked = sampling.mark(frame, 10, ["s"], 7)
    assert marked.columns == [*frame.columns, "sampled"] and marked.where("sampled").count() == 40 and marked.where("k = 'clash' and n = 1 and last = 2 and below = 3").count() == len(rows)


def test_choose_raises_for_a_label_without_rows(spark):
    rows = spark.createDataFrame([("a", "fake", "x"), ("b", "fake", "x"), ("c", None, "x"), ("d", "odd", "y")], "rel_path string, label string, s string")
    with pytest.raises(sampling.NoCandidates, match="no real items"):
        sampling.choose(rows, 1, "s")
    with pytest.raises(sampling.NoCandidates, match="no real or fake"):
        sampling.choose(rows.limit(0), 1, "s")
    got = sampling.choose(rows, 1, "s", labels=("fake",)).collect()
    assert [(r.rel_path, r.place) for r in got] == [(min("ab", key=lambda p: rank(0, p)), 1)]
