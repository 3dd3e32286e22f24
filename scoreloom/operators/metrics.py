"""Detection metrics overall and per group, with bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import roc
from .draws import with_counts
from .intervals import METRICS, Points, counted, in_ranges, intervals, segments_of, values_of
from .settle import settle

TARGETS = (0.01, 0.05)


def scored_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows that count for curves: status ok, with y and s."""
    return df.where("status = 'ok' and score is not null").select(*by, roc.binary().alias("y"), F.col("score").alias("s"))


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_real, n_fake, n_failed) over all rows, the failed ones included."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == "real").alias("n_real"),
        F.count_if(F.col("label") == "fake").alias("n_fake"),
        F.count_if(F.col("status") != "ok").alias("n_failed"),
    )


def at_threshold(df: DataFrame, by: list[str], threshold: str = "threshold") -> DataFrame:
    """(by, fpr, fnr, acc, bal_acc): a score at the threshold or above means fake; rates of a missing class are null."""
    ok = df.where("status = 'ok' and score is not null").withColumn("hit", (F.col("score") >= F.col(threshold)).cast("double"))
    real, fake = F.col("label") == "real", F.col("label") == "fake"
    got = ok.groupBy(*by).agg(
        F.avg(F.when(real, F.col("hit"))).alias("fpr"),
        F.avg(F.when(fake, 1 - F.col("hit"))).alias("fnr"),
        F.avg(F.when(F.col("hit").isNotNull(), (F.col("hit") == fake.cast("double")).cast("double"))).alias("acc"),
    )
    known = F.when(F.col("fpr").isNotNull(), 1).otherwise(0) + F.when(F.col("fnr").isNotNull(), 1).otherwise(0)
    mean = F.try_divide(F.coalesce("fpr", F.lit(0.0)) + F.coalesce("fnr", F.lit(0.0)), known)
    return got.withColumn("bal_acc", 1 - mean)


def curve_summary(df: DataFrame, by: list[str], targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(by, auc, ap, eer, threshold, tpr_at_fprNN)."""
    points = settle(roc.cumulative(scored_rows(df, by), by))  # areas and curve read them
    a, r = roc.areas_of(points, by), roc.readings(roc.vertices(points, by), by, targets)
    r = r.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & a[c].eqNullSafe(r[f"_{c}"])
    return a.join(r, same, "left").drop(*(f"_{c}" for c in by))


def summary(df: DataFrame, targets: tuple[float, ...] = TARGETS, replicates: int = 1000, key: str = "item_id") -> DataFrame:
    """One row: counts, areas, the equal error rate with its threshold, the rates at that threshold, and 95 % intervals of the
    area and the equal error rate."""
    one = settle(df.select(F.lit("all").alias("_all"), key, "label", "score", "status"))
    c = settle(curve_summary(one, ["_all"], targets))
    t = at_threshold(one.join(F.broadcast(c.select("_all", "threshold")), "_all"), ["_all"])  # one row
    i = intervals(one, "_all", replicates, key=key).withColumnRenamed("grp", "_all")
    out = counts(one, ["_all"])
    for part in (c, t, i):
        out = out.join(part, "_all", "left")
    return out.drop("_all")


def per_group(df: DataFrame, group: str, min_n: int = 30, targets: tuple[float, ...] = TARGETS, replicates: int = 1000, key: str = "item_id") -> DataFrame:
    """A row for each value of ``group``, missing values as <null>: own curves and intervals, but rates at the threshold of the
    whole set. ``small`` marks groups with fewer than ``min_n`` real or fake items."""
    df = settle(df.select(F.coalesce(F.col(group).cast("string"), F.lit("<null>")).alias("group"), key, "label", "score", "status"))
    one = scored_rows(df.withColumn("_all", F.lit(0)), ["_all"])
    whole = settle(roc.readings(roc.curve(one, ["_all"]), ["_all"], targets).select("threshold"))
    whole = F.broadcast(whole)  # one row
    t = at_threshold(df.join(whole, how="left"), ["group"])
    c = curve_summary(df, ["group"], targets).withColumnRenamed("threshold", "own_threshold")
    i = intervals(df, "group", replicates, key=key).withColumnRenamed("grp", "group")
    out = counts(df, ["group"])
    for part in (c, t, i):
        out = out.join(part, "group", "left")
    return out.join(whole, how="left").withColumn("small", (F.col("n_real") < min_n) | (F.col("n_fake") < min_n))


def direction_ok(df: DataFrame) -> DataFrame:
    """One row: whether fakes score above reals; false where that is undefined."""
    one = scored_rows(df.withColumn("_all", F.lit(0)), ["_all"])
    return roc.areas(one, ["_all"]).agg(F.coalesce(F.first("auc") > 0.5, F.lit(False)).alias("direction_ok"))


def hash_bootstrap(df: DataFrame, replicates: int = 1000, seed: int = 0, key: str = "item_id") -> DataFrame:
    """(replicate, auc, eer): each replicate draws as many reals and fakes as there are, with replacement, by hash. Draw k of
    class y takes the row whose rank in its class, by the hash of ``key``, is the hash of (seed, replicate, y, k) modulo the
    class's size. Ranks are counted in 4,096 parts of the hash's range and over the parts, so no class is sorted as a whole.
    Rows carry how often each replicate draws them (``draws``), in ranges of their scores, and curves are read as those of
    ``intervals`` are. Without rows of both classes there are no replicates."""
    rows = df.where("status = 'ok' and score is not null").select(key, roc.binary().alias("y"), F.col("score").cast("double").alias("s"))
    rows = rows.withColumn("h", F.sha1(key)).withColumn("part", F.substring("h", 1, 3))
    parts = rows.groupBy("y", "part").agg(F.count("*").alias("n"))
    parts = parts.select("y", "part", (F.sum("n").over(Window.partitionBy("y").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("y", "part").orderBy("h", key)) - 1
    # read for the sizes, the ranges and the draws: without this the join before is made for each
    rows = settle(rows.withColumn("local", local).join(parts, ["y", "part"]).select(F.lit("").alias("grp"), "s", "y", (F.col("before") + F.col("local")).alias("rank")))
    sizes = {y: n for y, n in rows.groupBy("y").count().collect()}  # two numbers
    rows = settle(in_ranges(rows, F.col("s").desc(), F.col("y"), F.col("rank")))
    ranges = rows.rdd.getNumPartitions()
    rows = settle(with_counts(rows, sizes, replicates, seed).repartitionById(ranges, F.col("part")).sortWithinPartitions("part", F.col("s").desc()))
    return values_of(rows, segments_of(rows, replicates, counted), counted).select(F.col("r").alias("replicate"), "auc", "eer")


#: Replicates that are weighed at once.
TOGETHER = 32


def exact_bootstrap(df: DataFrame, by: str, n: int = 1000, ci: float = 0.95, seed: int = 0, key: str = "item_id") -> DataFrame:
    """(by, auc_lo, auc_hi, eer_lo, eer_hi): percentile intervals of resamples that draw reals and fakes separately with a
    seeded generator, in the order of ``key``. A resample is how often each item was drawn, and is read off the curve in the
    order of scores, which all resamples share. The generator's sequence ties a group to one task, so groups must fit one
    (two numbers an item); ``intervals`` has no such bound."""
    names = [f"{c}_{end}" for c in ("auc", "eer") for end in ("lo", "hi")]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        fake, s = part["y"].to_numpy() == 1, part["s"].to_numpy(float)
        classes = [np.flatnonzero(~fake), np.flatnonzero(fake)]
        if not all(map(len, classes)):
            return pd.DataFrame([[part[by].iloc[0], *[None] * 4]], columns=[by, *names])
        rng, down, found = np.random.default_rng(seed), np.argsort(-s, kind="stable"), []
        begin = np.flatnonzero(np.diff(s[down], prepend=np.inf))
        for at in range(0, n, TOGETHER):
            drawn = np.zeros((min(TOGETHER, n - at), len(s)), np.int32)
            for row in drawn:
                for members in classes:
                    row += np.bincount(rng.choice(members, len(members)), minlength=len(s)).astype(np.int32)
            sides = (np.add.reduceat((drawn * side)[:, down].T, begin, axis=0, dtype=np.int64) for side in (fake, ~fake))
            dt, d_f = sides
            whole = [np.full(len(drawn), float(len(m))) for m in reversed(classes)]
            points = Points(s[down][begin][:, None], dt, d_f, np.cumsum(dt, axis=0).astype(float), np.cumsum(d_f, axis=0).astype(float), *whole)
            found.append(np.stack([METRICS[m].partial(points) for m in ("auc", "eer")]))
        ends = np.quantile(np.concatenate(found, axis=1), [(1 - ci) / 2, (1 + ci) / 2], axis=1).T.ravel().tolist()
        return pd.DataFrame([[part[by].iloc[0], *ends]], columns=[by, *names])

    rows = df.where("status = 'ok' and score is not null").select(F.coalesce(F.col(by).cast("string"), F.lit("<null>")).alias(by), key, roc.binary().alias("y"), F.col("score").alias("s"))
    return rows.groupBy(by).applyInPandas(work, f"`{by}` string, {', '.join(f'{c} double' for c in names)}")
