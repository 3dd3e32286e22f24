"""Bootstrap intervals of numbers read off curves, for all groups at once and however large one is.

A replicate weighs each item by a Poisson number of mean 1, the limit of drawing as many items as there are with
replacement, class by class; the number follows from a hash of the item's key and the replicate, so any engine and any
partitioning draws the same. Items are range-partitioned by group, score and hash, so that neither a group nor a score that
all items share ends up in one task. A first pass over each range, a few thousand items at a time, gives for every
replicate the weights of both classes and the pairs that the range orders itself; its first and last score, which other
ranges may share, are kept apart and added up over the ranges. Running sums give what stands above each range. With that, a
range tells its part of any metric that adds up, or is an extreme, over a curve's points (``Metric``): a second pass reads
the ranges, for the equal error rate only those in which a replicate's error rates cross. The area needs no second pass.

A replicate without a weighted item of both classes has no value and is left out; a group with only such replicates has
no row. Rows that failed or have no score don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import roc
from .settle import settle

#: The modulus and the multipliers of the replicates' draws.
PRIME, STEPS = 2**31 - 1, (48_271, 69_621, 16_807)
#: Items that are weighed at once, numbers that a second pass holds at once, and items of a range, about.
BLOCK, HELD, RANGE_ROWS = 1_024, 4_000_000, 1 << 16
CACHED = 32
#: The distribution of a Poisson number of mean 1, as far as a draw of 31 bits tells.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 11)]))


def start(key: str) -> Column:
    """The number from which an item's draws follow: 28 bits of a hash."""
    return F.conv(F.substring(F.sha1(key), 1, 7), 16, 10).cast("long")


#: The least draw of each further Poisson number.
_LEAST = np.searchsorted(np.arange(PRIME - 4_096, PRIME) / PRIME, POISSON) + PRIME - 4_096  # those near the end
_LEAST = np.where(POISSON < (PRIME - 4_096) / PRIME, np.ceil(POISSON * PRIME).astype(np.int64), _LEAST)


def _fold(x: np.ndarray, room: np.ndarray) -> None:
    """x of at most 62 bits to the prime or less, modulo the prime, which is one less than a power of two; in place."""
    for _ in range(2):
        np.right_shift(x, 31, out=room)
        np.bitwise_and(x, PRIME, out=x)
        np.add(x, room, out=x)


def weights(begin: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A row for each item, a column for each replicate. Few rows at a time, which a processor's cache holds."""
    a, b, c = STEPS
    r = replicates.astype(np.int64)[None, :]
    out = np.zeros((len(begin), r.shape[1]), np.int8)
    least = _LEAST[_LEAST < PRIME].astype(np.int32)
    for at in range(0, len(begin), CACHED):
        x0 = begin[at : at + CACHED].astype(np.int64)[:, None]
        x = x0 * a + (r * b + 1)
        room = np.empty_like(x)
        _fold(x, room)
        np.multiply(x, x, out=x)
        x += x0
        _fold(x, room)
        x *= c
        x += r
        _fold(x, room)
        np.multiply(x, x, out=x)
        x += 7
        _fold(x, room)
        x[x == PRIME] = 0
        drawn, part = x.astype(np.int32), out[at : at + CACHED]
        for k in least:
            part += drawn >= k
    return out


def counted(drawn: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The same of items that carry their weights, a byte for each replicate."""
    return np.frombuffer(b"".join(drawn), np.uint8).reshape(len(drawn), -1)[:, replicates]


#: What makes an item's number or bytes (x0) its weights.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _runs(scores: np.ndarray) -> np.ndarray:
    """Where each run of equal scores begins."""
    return np.concatenate([[0], np.flatnonzero(np.diff(scores)) + 1])


_SUMS = "grp string, part int, kind int, s double, low double, t array<double>, f array<double>, pairs array<double>"


def _range_sums(rows: DataFrame, n: int, weigh: Weigh = weights) -> DataFrame:
    """``rows(grp, s, y, x0, part)``, sorted, to what each range has for each replicate: the weights of its first and of its
    last score (kind 0), which other ranges may share, and the weights and ordered pairs of the scores between (kind 1)."""
    replicates = np.arange(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None  # the group and the range at hand
        head, between = None, False  # the first score with its weights; whether others were closed since
        sums = np.zeros((3, n))  # fakes, reals, pairs of a fake above a real, of the scores between
        tie, tied = None, np.zeros((2, n))  # the last score, which may go on, and its weights

        def close() -> None:
            nonlocal head, between
            if head is None:
                head = (tie, tied.copy())
            else:
                between = True
                sums[2] += tied[1] * (sums[0] + tied[0] / 2)
                sums[:2] += tied
            tied[:] = 0

        def out() -> pa.RecordBatch:
            nonlocal head, between
            found = [(0, tie, tie, *tied, np.zeros(n))]
            if head is not None:
                found.append((0, head[0], head[0], *head[1], np.zeros(n)))
            if between:
                found.append((1, head[0], tie, *sums))
            kind, s, low, *arrays = zip(*found, strict=True)
            columns = [pa.array([at[0]] * len(found)), pa.array([at[1]] * len(found), pa.int32()), pa.array(kind, pa.int32()), pa.array(s, pa.float64()), pa.array(low, pa.float64())]
            columns += [pa.array([x.tolist() for x in a], pa.list_(pa.float64())) for a in arrays]
            sums[:], tied[:], head, between = 0, 0, None, False
            return pa.RecordBatch.from_arrays(columns, ["grp", "part", "kind", "s", "low", "t", "f", "pairs"])

        for b in batches:
            groups, parts = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 4))
            s, y, x0 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if at != (groups[lo], parts[lo]):
                    if at is not None:
                        yield out()
                    at, tie = (groups[lo], parts[lo]), None
                for i in range(lo, hi, BLOCK):
                    j = min(hi, i + BLOCK)
                    w, fake = weigh(x0[i:j], replicates), (y[i:j] == 1)[:, None]
                    begin = _runs(s[i:j])
                    t, f = (np.add.reduceat(w * side, begin, axis=0, dtype=np.int32) for side in (fake, ~fake))
                    if tie is not None and s[i] != tie:
                        close()
                    tied[0] += t[0]
                    tied[1] += f[0]
                    tie = s[i]
                    if len(begin) > 1:
                        close()
                        t, f = t[1:], f[1:]
                        between = between or len(t) > 1
                        twice = 2 * np.cumsum(t[:-1], axis=0, dtype=np.int32) - t[:-1]  # fakes above, and half of the tied
                        reals = f[:-1].sum(axis=0)
                        sums[2] += sums[0] * reals + np.einsum("ij,ij->j", f[:-1].astype(np.int64), twice.astype(np.int64)) / 2
                        sums[0] += t[:-1].sum(axis=0)
                        sums[1] += reals
                        tied[0], tied[1] = t[-1], f[-1]
                        tie = s[j - 1]
        if at is not None:
            yield out()

    return rows.mapInArrow(work, _SUMS)


# --- metrics ------------------------------------------------------------------------------------------------------
@dataclass
class Points:
    """Some successive points of curves from the highest score down, a row for each score and a column for each replicate:
    weights at the score and up to it, and of all in the last two."""

    s: np.ndarray
    dt: np.ndarray
    df: np.ndarray
    tps: np.ndarray
    fps: np.ndarray
    P: np.ndarray
    N: np.ndarray


@dataclass
class Metric:
    """A number read off a curve: ``partial`` of some of its points, for each replicate, and how partial numbers merge: sum,
    max or min. Points without weight must not matter."""

    partial: Callable[[Points], np.ndarray]
    merge: str = "sum"


def _area(p: Points) -> np.ndarray:
    return (p.df * (p.tps - p.dt / 2)).sum(axis=0) / (p.P * p.N)


def _precision(p: Points) -> np.ndarray:
    return (p.dt * p.tps / np.maximum(p.tps + p.fps, 1)).sum(axis=0) / p.P


def _equal_error(p: Points) -> np.ndarray:
    """Where misses minus false alarms, times both classes' weights, fall to zero. A crossing at a point itself may show on
    both sides of it, with the same value."""
    whole = p.P * p.N
    before = whole - (p.tps - p.dt) * p.N - (p.fps - p.df) * p.P
    step = p.dt * p.N + p.df * p.P
    crosses = (step > 0) & (before > -1e-12 * whole) & (before - step <= 1e-12 * whole)
    share = np.clip(before / np.where(step > 0, step, 1), 0, 1)
    return np.where(crosses, (p.fps - p.df + share * p.df) / p.N, np.inf).min(axis=0)


def tpr_within(target: float) -> Metric:
    """The best rate of fakes found that some threshold reaches with at most ``target`` of the reals."""
    return Metric(lambda p: np.where(p.fps / p.N <= target, p.tps / p.P, 0.0).max(axis=0), "max")


#: auc and eer are what ``intervals`` gives too, with one pass less.
METRICS = {"auc": Metric(_area), "ap": Metric(_precision), "eer": Metric(_equal_error, "min"), "tpr_at_fpr01": tpr_within(0.01), "tpr_at_fpr05": tpr_within(0.05)}
_CARRIED = ["before_t", "before_f", "all_t", "all_f"]


def _of_ranges(rows: DataFrame, carried: DataFrame, metrics: dict[str, Metric], weigh: Weigh) -> DataFrame:
    """(grp, r, a number for each metric): ``rows`` of ranges, without their first and last score, under the replicates of
    ``carried(grp, part, r, before_t, before_f, all_t, all_f)``."""
    names = list(metrics)

    def work(items: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("s", ascending=False, kind="stable")
        if not len(wanted) or not len(items):
            return pd.DataFrame({c: [] for c in ("grp", "r", *names)})
        s, fake, x0 = items["s"].to_numpy(), (items["y"].to_numpy() == 1)[:, None], items["x0"].to_numpy()
        begin, values = _runs(s), []
        step = max(1, HELD // len(items))
        for lo in range(0, len(wanted), step):
            some = wanted.iloc[lo : lo + step]
            w = weigh(x0, some["r"].to_numpy())
            dt, df = (np.add.reduceat(w * side, begin, axis=0, dtype=np.int64) for side in (fake, ~fake))
            bt, bf, at, af = (some[c].to_numpy(float) for c in _CARRIED)
            points = Points(s[begin][:, None], dt, df, bt + np.cumsum(dt, axis=0), bf + np.cumsum(df, axis=0), at, af)
            values.append(np.stack([metrics[name].partial(points) for name in names], axis=1))
        return pd.DataFrame({"grp": wanted["grp"].to_numpy(), "r": wanted["r"].to_numpy(), **dict(zip(names, np.concatenate(values).T, strict=True))})

    schema = ", ".join(["grp string, r long", *(f"`{name}` double" for name in names)])
    return rows.groupBy("grp", "part").cogroup(carried.groupBy("grp", "part")).applyInPandas(work, schema)


def _of_scores(scores: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """The same of single scores, ``scores(grp, r, s, t, f, before_t, before_f, all_t, all_f)``, a point each."""
    names = list(metrics)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s, dt, df, bt, bf, at, af = (b[c].to_numpy(float) for c in ("s", "t", "f", *_CARRIED))
                points = Points(s[None], dt[None], df[None], (bt + dt)[None], (bf + df)[None], at, af)
                yield pd.DataFrame({"grp": b["grp"], "r": b["r"], **{name: m.partial(points) for name, m in metrics.items()}})

    schema = ", ".join(["grp string, r long", *(f"`{name}` double" for name in names)])
    return scores.select("grp", "r", "s", "t", "f", *_CARRIED).mapInPandas(work, schema)


# --- replicates ---------------------------------------------------------------------------------------------------
def _segments(df: DataFrame, by: str, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that count, in ranges, and the segments of their curves."""
    ok = df.where("status = 'ok' and score is not null")
    rows = ok.select(F.coalesce(F.col(by).cast("string"), F.lit("<null>")).alias("grp"), F.col("score").cast("double").alias("s"), roc.binary().alias("y"), start(key).alias("x0"))
    order = [F.col("grp"), F.col("s").desc(), F.col("x0")]  # equal scores may part: a score that all share is in all ranges
    rows = settle(in_ranges(rows, *order).sortWithinPartitions(*order))
    return rows, segments_of(rows, n)


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` by ranges of ``order``, whose number is ``part``."""
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    return rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())


def segments_of(rows: DataFrame, n: int, weigh: Weigh = weights) -> DataFrame:
    """For each replicate of each group of ``rows(grp, s, y, x0, part)``, each range sorted in one partition, the segments of
    its curve with what stands above them: scores that end a range (kind 0), and the scores between (kind 1, from s exclusive
    down to low exclusive)."""
    sums = settle(_range_sums(rows, n, weigh))
    each = sums.select("grp", "part", "kind", "s", "low", F.posexplode(F.arrays_zip("t", "f", "pairs")).alias("r", "v")).select("grp", "part", "kind", "s", "low", F.col("r").cast("long").alias("r"), "v.*")
    scores = each.where("kind = 0").groupBy("grp", "s", "r").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    scores = scores.withColumns({"pairs": F.col("t") * F.col("f") / 2, "part": F.lit(None).cast("int"), "kind": F.lit(0), "low": F.col("s")})
    each = scores.unionByName(each.where("kind = 1"))
    so_far, whole = Window.partitionBy("grp", "r").orderBy(F.col("s").desc(), "kind"), Window.partitionBy("grp", "r")
    each = each.withColumns({"before_t": F.sum("t").over(so_far) - F.col("t"), "before_f": F.sum("f").over(so_far) - F.col("f"), "all_t": F.sum("t").over(whole), "all_f": F.sum("f").over(whole)})
    return settle(each.where("all_t > 0 and all_f > 0"))


def _metrics_of(rows: DataFrame, segments: DataFrame, metrics: dict[str, Metric], weigh: Weigh = weights) -> DataFrame:
    """(grp, r, the metrics' numbers) over ``segments``, partial numbers merged."""
    between = segments.where("kind = 1")
    inside = between.select("grp", "part", F.col("s").alias("high"), "low").distinct()
    inside = rows.join(F.broadcast(inside), ["grp", "part"]).where("s < high and s > low").select("grp", "part", "s", "y", "x0")
    parts = _of_ranges(inside, between.select("grp", "part", "r", *_CARRIED), metrics, weigh).unionByName(_of_scores(segments.where("kind = 0"), metrics))
    merges = {"sum": F.sum, "max": F.max, "min": F.min}
    return parts.groupBy("grp", "r").agg(*(merges[m.merge](name).alias(name) for name, m in metrics.items()))


def replicate_values(df: DataFrame, by: str, n: int = 1000, key: str = "item_id") -> DataFrame:
    """(grp, r, auc, eer) for each replicate r of each group that has both classes in it."""
    return values_of(*_segments(df, by, n, key))


def values_of(rows: DataFrame, each: DataFrame, weigh: Weigh = weights) -> DataFrame:
    """The same of rows in ranges and the segments of their curves."""
    areas = each.groupBy("grp", "r").agg((F.sum(F.col("pairs") + F.col("f") * F.col("before_t")) / F.first(F.col("all_t") * F.col("all_f"))).alias("auc"))
    above = F.expr("1 - before_t / all_t - before_f / all_f > 0")
    below = F.expr("1 - (before_t + t) / all_t - (before_f + f) / all_f <= 0")
    # sums of fractions may miss 0 by a little, so a neighbour that all but crosses is looked at too
    near = F.expr("1 - before_t / all_t - before_f / all_f > -1e-9 and 1 - (before_t + t) / all_t - (before_f + f) / all_f <= 1e-9")
    return areas.join(_metrics_of(rows, each.where((above & below) | near), {"eer": METRICS["eer"]}, weigh), ["grp", "r"], "left")


def metric_values(df: DataFrame, by: str, metrics: dict[str, Metric], n: int = 1000, key: str = "item_id") -> DataFrame:
    """(grp, r, a number for each of ``metrics``) for each replicate r of each group that has both classes in it."""
    return _metrics_of(*_segments(df, by, n, key), metrics)


def _ends(values: DataFrame, names: list[str], ci: float) -> DataFrame:
    tail = (1 - ci) / 2
    return values.groupBy("grp").agg(*(F.percentile(c, F.lit(q)).alias(f"{c}_{end}") for c in names for end, q in (("lo", tail), ("hi", 1 - tail))))


def intervals(df: DataFrame, by: str, n: int = 1000, ci: float = 0.95, key: str = "item_id") -> DataFrame:
    """(grp, auc_lo, auc_hi, eer_lo, eer_hi): the percentiles that hold ``ci`` of the replicates."""
    return _ends(replicate_values(df, by, n, key), ["auc", "eer"], ci)


def metric_intervals(df: DataFrame, by: str, metrics: dict[str, Metric], n: int = 1000, ci: float = 0.95, key: str = "item_id") -> DataFrame:
    """(grp, lo and hi of each of ``metrics``): any number that adds up, or is an extreme, over the points of a curve."""
    return _ends(metric_values(df, by, metrics, n, key), list(metrics), ci)
