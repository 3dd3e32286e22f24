"""ROC curves and what is read off them, for any number of groups in one plan.

Input rows are (group columns, y, s): y is 1 for fake and 0 for real, s the score; both not null. Scores are first reduced
to distinct values with counts, which are range-partitioned by group and score, written once, and read by all that follows.
Running sums are taken in two steps, in these ranges and then over them, so that not even one large group is sorted in one
task, whatever its scores look like. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle


def cumulative(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, s, dtp, dfp, tps, fps, P, N, before_t, before_f, next_t, next_f): a row for each distinct score, from the highest.

    before_* are the sums at the score above (null at the first), next_* at the score below (null at the last)."""
    w = F.col(weight) if weight else F.lit(1)
    points = rows.groupBy(*by, "s").agg(F.sum(F.col("y") * w).cast("double").alias("dtp"), F.sum((1 - F.col("y")) * w).cast("double").alias("dfp"))
    order = [*(F.col(c) for c in by), F.col("s").desc()]
    points = points.where("dtp > 0 or dfp > 0").repartitionByRange(*order)
    points = settle(points.withColumn("band", F.spark_partition_id()))
    first = F.max_by(F.struct("dtp", "dfp"), "s")
    bands = points.groupBy(*by, "band").agg(F.sum("dtp").alias("bt"), F.sum("dfp").alias("bf"), first.alias("first"))
    down = Window.partitionBy(*by).orderBy("band")
    whole = Window.partitionBy(*by)
    bands = bands.select(
        *by,
        "band",
        (F.sum("bt").over(down) - F.col("bt")).alias("ot"),
        (F.sum("bf").over(down) - F.col("bf")).alias("of"),
        F.sum("bt").over(whole).alias("P"),
        F.sum("bf").over(whole).alias("N"),
        F.lead("first").over(down).alias("below"),
        F.row_number().over(down).alias("nth"),
    )
    bands = bands.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & points[c].eqNullSafe(bands[f"_{c}"])
    joined = points.join(bands.withColumnRenamed("band", "_band"), same & (points["band"] == F.col("_band"))).drop("_band", *(f"_{c}" for c in by))
    inside = Window.partitionBy(*by, "band").orderBy(F.col("s").desc())
    out = joined.withColumns({"tps": F.col("ot") + F.sum("dtp").over(inside), "fps": F.col("of") + F.sum("dfp").over(inside)})
    lead = F.lead(F.struct("dtp", "dfp")).over(inside)
    out = out.withColumns({"here": F.row_number().over(inside), "ahead": F.coalesce(lead, F.col("below"))})
    start = (F.col("here") == 1) & (F.col("nth") == 1)
    return out.select(
        *by, "s", "dtp", "dfp", "tps", "fps", "P", "N",
        F.when(~start, F.col("tps") - F.col("dtp")).alias("before_t"),
        F.when(~start, F.col("fps") - F.col("dfp")).alias("before_f"),
        (F.col("tps") + F.col("ahead.dtp")).alias("next_t"),
        (F.col("fps") + F.col("ahead.dfp")).alias("next_f"),
    )


def curve(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, threshold, fpr, tpr): the retained vertices. Points in a line with both neighbours are left out, and (0, 0) with
    no threshold comes first."""
    return vertices(cumulative(rows, by, weight), by)


def vertices(points: DataFrame, by: list[str]) -> DataFrame:
    """The curve of ``cumulative`` points."""
    bend = lambda a, b, c: (F.col(c) - 2 * F.col(b) + F.col(a)) != 0
    ends = F.col("before_t").isNull() | F.col("next_t").isNull()
    kept = points.where(ends | bend("before_t", "tps", "next_t") | bend("before_f", "fps", "next_f"))
    rates = F.try_divide("fps", "N").alias("fpr"), F.try_divide("tps", "P").alias("tpr")
    zero = lambda n, name: F.when(F.col(n) > 0, F.lit(0.0)).alias(name)
    origin = points.where("before_t is null").select(*by, F.lit(None).cast("double").alias("threshold"), zero("N", "fpr"), zero("P", "tpr"))
    return kept.select(*by, F.col("s").alias("threshold"), *rates).unionByName(origin)


def areas(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, auc, ap): trapezoid area and average precision; null where a class is missing."""
    return areas_of(cumulative(rows, by, weight), by)


def areas_of(points: DataFrame, by: list[str]) -> DataFrame:
    """The areas of ``cumulative`` points."""
    both = (F.first("P") > 0) & (F.first("N") > 0)
    auc = F.sum(F.col("dfp") * (F.col("tps") - F.col("dtp") / 2)) / F.first(F.nullif(F.col("P") * F.col("N"), F.lit(0.0)))
    ap = F.sum(F.col("dtp") / F.nullif(F.col("P"), F.lit(0.0)) * F.col("tps") / (F.col("tps") + F.col("fps")))
    return points.groupBy(*by).agg(F.when(both, auc).alias("auc"), F.when(both, ap).alias("ap"))


def readings(curve: DataFrame, by: list[str], targets: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """(by, eer, threshold, tpr_at_fprNN): the equal error rate, interpolated between the vertices about the crossing, its
    vertex's own threshold, and the best rate at each target without interpolation."""
    # along the curve fnr - fpr never rises: the last vertex above zero and the first that isn't are its crossing
    diff = F.lit(1.0) - F.col("tpr") - F.col("fpr")
    v = curve.withColumn("diff", diff)
    spot = F.struct("diff", "fpr", "threshold")
    # of vertices with equal diff the one nearest the crossing on either side is on the curve's inner end
    above = F.max_by(spot, F.when(F.col("diff") > 0, F.struct(-F.col("diff"), F.col("fpr")))).alias("a")
    below = F.min_by(spot, F.when(F.col("diff") <= 0, F.struct(-F.col("diff"), F.col("fpr")))).alias("b")
    rates = [F.max(F.when(F.col("fpr") <= t, F.col("tpr"))).alias(tpr_key(t)) for t in targets]
    got = v.groupBy(*by).agg(above, below, *rates)
    part = F.col("a.diff") / (F.col("a.diff") - F.col("b.diff"))
    eer = F.col("a.fpr") + part * (F.col("b.fpr") - F.col("a.fpr"))
    both = F.col("b.diff").isNotNull() & F.col("a.diff").isNotNull()
    return got.select(*by, F.when(both, eer).alias("eer"), F.when(both, F.col("b.threshold")).alias("threshold"), *(F.when(both, F.col(tpr_key(t))).alias(tpr_key(t)) for t in targets))


def tpr_key(target: float) -> str:
    return f"tpr_at_fpr{round(target * 100):02d}"


def binary(label: str = "label") -> Column:
    return (F.col(label) == "fake").cast("int")
