"""Greedy suppression of overlapping boxes in crowded frames, by rounds of rank and a grid.

A round takes the ``BATCH`` best undecided boxes of each frame and goes through them in order, in a task for each frame; the
boxes that are kept then meet all others through a grid, which suppresses those that they overlap, and the next round begins.
Boxes that overlap by more than a threshold t have sizes within a factor of t, and their middles lie close. A box's level is
the power of two that its longer side fits in. An undecided box stands in one cell, that of its middle at its level; a kept
one in all cells that may have the middle of a box it conflicts with. So an undecided box is shuffled once in a round, however
large its frame is, and since kept boxes don't conflict, a cell has few of them, however many others lie on top of each other.
What is kept in the end is what going through all boxes in order keeps, by score, then by idx, both downwards; a frame takes
one round for each ``BATCH`` boxes, less what is suppressed.

Boxes without a frame or with a null among score, idx or corners are left out, as are those without an area; rows of one frame that repeat an idx
count as one box, the best; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

CORNERS = ("x1", "y1", "x2", "y2")
#: Boxes of a frame that a round goes through in order.
BATCH = 1 << 14


def _side(low: Column, high: Column) -> Column:
    return F.greatest(high - low + 1, F.lit(0.0))


def _overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = _side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * _side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    area = lambda c: (c["x2"] - c["x1"] + 1) * (c["y2"] - c["y1"] + 1)
    return inter / (area(a) + area(b) - inter)


def _level(wide: Column, high: Column) -> Column:
    return F.ceil(F.log2(F.greatest(wide, high))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _at_home(boxes: DataFrame) -> DataFrame:
    """Each box in the one cell of its level that has its middle."""
    rows = boxes.withColumn("level", _level(F.expr("x2 - x1 + 1"), F.expr("y2 - y1 + 1")))
    return rows.withColumns({"cx": _cell(F.expr("(x1 + x2) / 2"), F.col("level")), "cy": _cell(F.expr("(y1 + y2) / 2"), F.col("level"))})


def _in_reach(boxes: DataFrame, threshold: float) -> DataFrame:
    """Each box in all cells that may have the middle of a box it conflicts with. On either axis such a one is less than
    1 / t times as long, and shares more than t of the longer length; so the middles lie apart by less than half of both
    lengths without that."""
    above = math.ceil(math.log2(1 / threshold))
    rows = boxes.withColumn("_own", _level(F.expr("x2 - x1 + 1"), F.expr("y2 - y1 + 1")))
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("_own") - above, F.col("_own") + above)))
    for low, high, cell in (("x1", "x2", "cx"), ("y1", "y2", "cy")):
        length = F.col(high) - F.col(low) + 1
        most = F.least(length / threshold, F.pow(F.lit(2.0), F.col("level")))
        apart = lambda other: (length + other) / 2 - F.greatest(length, other) * threshold  # noqa: E731, B023
        far = F.greatest(apart(F.least(length, most)), apart(most)) * (1 + 1e-9) + 1e-6
        middle = (F.col(low) + F.col(high)) / 2
        cells = F.sequence(_cell(middle - far, F.col("level")), _cell(middle + far, F.col("level")))
        rows = rows.withColumn(cell, F.explode(F.when(far > 0, cells)))
    return rows.drop("_own")


def best_first(batch: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The boxes of one frame that are kept, going through them from the best down."""
    batch = batch.sort_values(["score", "idx"], ascending=False)
    x1, y1, x2, y2 = (batch[c].to_numpy(float) for c in CORNERS)
    area = (x2 - x1 + 1) * (y2 - y1 + 1)
    open_ = np.ones(len(batch), bool)
    for i in range(len(batch)):
        if open_[i]:  # it is kept; what it overlaps goes
            rest = np.flatnonzero(open_[i + 1 :]) + i + 1
            wide = np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]) + 1
            high = np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]) + 1
            inter = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
            open_[rest[inter / (area[i] + area[rest] - inter) > threshold]] = False
    return batch[open_]


def suppress(boxes: DataFrame, threshold: float, frame: str = "frame", batch: int = BATCH) -> DataFrame:
    """``boxes(frame, idx, score, x1, y1, x2, y2)`` to the (frame, idx) that are kept."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    rows = boxes.select(F.col(frame).alias("frame"), F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"), *corners).dropna()
    rows = rows.where("x2 - x1 + 1 > 0 and y2 - y1 + 1 > 0").groupBy("frame", "idx").agg(F.max(F.struct("score", *CORNERS)).alias("box"))
    left, kept = settle(rows.select("frame", "idx", "box.*")), []
    order = Window.partitionBy("frame").orderBy(F.col("score").desc(), F.col("idx").desc())
    while True:
        first = settle(left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= batch).drop("_n"))
        kept.append(settle(first.groupBy("frame").applyInPandas(lambda b: best_first(b, threshold), first.schema)))
        last = first.groupBy(F.col("frame").alias("b_frame")).agg(F.min(F.struct("score", "idx")).alias("b_last"))  # a row for each frame
        rest = left.join(last, (F.col("frame") == F.col("b_frame")) & (F.struct("score", "idx") < F.col("b_last"))).drop("b_frame", "b_last")
        by = _in_reach(kept[-1], threshold).select(*(F.col(c).alias(f"b_{c}") for c in ("frame", "level", "cx", "cy", *CORNERS)))
        same = F.lit(True)
        for c in ("frame", "level", "cx", "cy"):
            same = same & (F.col(c) == F.col(f"b_{c}"))
        over = _overlap({c: F.col(c) for c in CORNERS}, {c: F.col(f"b_{c}") for c in CORNERS}) > threshold
        left = settle(_at_home(rest).join(by, same & over, "left_anti").drop("level", "cx", "cy"))
        if left.isEmpty():
            break
    out = kept[0].select("frame", "idx")
    for part in kept[1:]:
        out = out.unionByName(part.select("frame", "idx"))
    return out
