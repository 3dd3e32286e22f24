"""Exact order statistics and quantiles of groups of any size, all groups in one plan.

A wanted rank starts with the whole span of its group's values. Rows count themselves into ``BINS`` bins of each open span, tasks add up before the shuffle, and running counts over the bins tell which bin has the rank; that bin's own least
and largest value are the next span. A span is finished when it holds one value only; when it holds ``SMALL`` rows or
fewer, these are ordered. So neither a group nor its distinct values are ever in one task, and rows don't shuffle: only bins
do. Groups of at most ``SMALL`` rows are ordered at once.

Null values and NaN don't count; a group without a value has no row; null group keys are a group; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

#: Bins of a span; rows that one task orders at once; rows of a table that is broadcast, at most.
BINS, SMALL, BROADCAST_ROWS = 4096, 1 << 16, 10_000


def with_table(rows: DataFrame, small: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """``rows`` joined to a table that is broadcast if it has few rows, and else joined as the planner thinks best, which
    splits hot keys at run time."""
    return rows.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on)


def _scale(v: Column) -> Column:
    """Sign and magnitude: a number that grows with v and by one with each doubling."""
    return F.signum(v) * (F.coalesce(F.log2(F.abs(v)), F.lit(-1075.0)) + 1075)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v in its span: bins of equal width, or by magnitude where a span has values of very different ones, so that
    a few rounds tell any two numbers apart."""
    wide = (lo < 0) & (hi > 0) | (F.greatest(F.abs(lo), F.abs(hi)) > BINS * F.least(F.abs(lo), F.abs(hi)))
    share = F.when(wide, (_scale(v) - _scale(lo)) / (_scale(hi) - _scale(lo))).otherwise((v - lo) / (hi - lo))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def order_statistics(rows: DataFrame, wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """``rows(k, v)`` and ``wanted(k, rank, n, lo, hi)``, the ranks (from 0) to look for in groups of n rows between lo and hi,
    to (k, rank, value, below), below being the number of rows with smaller values."""
    state = settle(wanted.select("k", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    finished = []
    while True:
        finished.append(state.where(F.col("lo") == F.col("hi")).select("k", "rank", F.col("lo").alias("value"), "below"))
        few = state.where((F.col("lo") < F.col("hi")) & (F.col("inside") <= small))
        spans = with_table(rows, few.select("k", "lo", "hi").distinct(), "k").where("v between lo and hi")
        inside = Window.partitionBy("k", "lo").orderBy("v")
        spans = spans.withColumns({"here": F.row_number().over(inside) - 1, "less": F.rank().over(inside) - 1})
        found = spans.join(few.drop("hi"), ["k", "lo"]).where(F.col("here") == F.col("rank") - F.col("below"))
        finished.append(found.select("k", "rank", F.col("v").alias("value"), (F.col("below") + F.col("less")).alias("below")))
        open_ = state.where((F.col("lo") < F.col("hi")) & (F.col("inside") > small))
        if open_.isEmpty():
            break
        hits = with_table(rows, settle(open_.select("k", "lo", "hi").distinct()), "k").where("v between lo and hi")
        bins = hits.groupBy("k", "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
        bins = bins.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.partitionBy("k", "lo", "hi").orderBy("bin")) - F.col("n")
        bins = bins.withColumn("before", before).select("k", "lo", "hi", "n", "least", "most", "before")
        at = F.col("rank") - F.col("below") - F.col("before")
        chosen = open_.join(bins, ["k", "lo", "hi"]).where((at >= 0) & (at < F.col("n")))
        state = settle(chosen.select("k", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside")))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def _keyed(df: DataFrame, by: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """(k, v) of the rows that count, and (k, n, lo, hi) of their groups."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("k"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    return rows, settle(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))


def exact_quantiles(df: DataFrame, by: list[str], value: Column, quantiles: dict[str, float], small: int = SMALL) -> DataFrame:
    """(by, a column for each of ``quantiles``): linear between the two nearest ranks, as ``percentile`` gives them."""
    if not all(0 <= q <= 1 for q in quantiles.values()):
        raise ValueError("quantiles must be from 0 to 1")
    rows, groups = _keyed(df, by, value)
    places = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in quantiles.items()}
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in places.values() for f in (F.floor, F.ceil))))
    found = order_statistics(rows, groups.select("*", F.explode(ranks).alias("rank")), small)
    values = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))

    def between(place: Column) -> Column:
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("values", low), F.element_at("values", high)
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    out = groups.join(values, "k").select(*(F.col(f"k.{c}").alias(c) for c in by), *(between(p).alias(name) for name, p in places.items()))
    return out


def least_ranks(df: DataFrame, by: list[str], value: Column, count: int, small: int = SMALL) -> DataFrame:
    """(k, n, last, below) for each group of more than ``count`` rows: its ``count``-th smallest value and the rows below
    it. k is the struct of ``by``."""
    rows, groups = _keyed(df, by, value)
    wanted = groups.where(F.col("n") > count).withColumn("rank", F.lit(count - 1).cast("long"))
    found = order_statistics(rows, wanted, small).select("k", F.col("value").alias("last"), "below")
    return groups.select("k", "n").join(found, "k")
