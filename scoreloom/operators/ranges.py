"""Joins of half-open ranges of whole numbers, such as video frames and audio samples on one clock.

A range's level is the power of two that its length fits in. At its level a range touches two buckets at most. Two ranges
are matched at the larger of their levels, in the first bucket that both touch, so each pair comes about once, and a long
item is spread over as many keys as it has buckets. A range goes up to the levels that the other side has above its own:
64 at most, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: str, end: str) -> Column:
    return F.length(F.bin(F.col(end) - F.col(start) - 1))


def _levels(rows: DataFrame, start: str, end: str) -> list[int]:
    """The levels of all rows: at most 64 numbers."""
    return sorted(r[0] for r in rows.select(_level(start, end)).distinct().collect())


def _bucketed(rows: DataFrame, start: str, end: str, others: list[int], prefix: str) -> DataFrame:
    level = _level(start, end)
    above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > level)
    rows = rows.withColumn(f"{prefix}_level", level).withColumn("_level", F.explode(F.concat(F.array(level), above)))
    first = F.expr(f"shiftright(`{start}`, _level)")
    return rows.withColumn(f"{prefix}_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.expr(f"shiftright(`{end}` - 1, _level)"))))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``by`` whose ranges [start, end) share a number. The columns of both sides but ``by`` must have
    different names, and none that begins with an underscore. Empty ranges and null keys or ends pair with nothing."""
    (a, b), (c, d) = left_range, right_range
    left, right = (rows.where(F.col(e) > F.col(s)).withColumns({s: F.col(s).cast("long"), e: F.col(e).cast("long")}) for rows, s, e in ((left, a, b), (right, c, d)))
    names = [*left.columns, *(x for x in right.columns if x not in by)]
    pairs = _bucketed(left, a, b, _levels(right, c, d), "_l").join(_bucketed(right, c, d, _levels(left, a, b), "_r"), [*by, "_level", "_bucket"])
    overlap = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    once = (F.greatest("_l_level", "_r_level") == F.col("_level")) & (F.greatest("_l_first", "_r_first") == F.col("_bucket"))
    return pairs.where(overlap & once).select(*names)
