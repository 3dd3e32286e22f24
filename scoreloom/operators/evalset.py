"""Evaluation sets: filtered and relabelled components, their union, and stratified subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_rank


class EvalsetError(ValueError):
    """A set that can't be assembled."""


def apply_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns are (one of) the wanted values; a column that isn't there is an error."""
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise EvalsetError(f"no such columns: {missing}")
    tests = [F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in wanted.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def relabel(df: DataFrame, rule: str) -> DataFrame:
    """``from_manifest``, a forced ``real`` or ``fake``, or the label of a track (``from_video``, ``from_audio``), which must
    not be null."""
    if rule == "from_manifest":
        return df
    if rule in ("real", "fake"):
        return df.withColumn("label", F.lit(rule))
    track = {"from_video": "label_video", "from_audio": "label_audio"}.get(rule)
    if track is None or track not in df.columns:
        raise EvalsetError(f"no labels for {rule!r}")
    return df.withColumn("label", F.coalesce(F.col(track), F.raise_error(F.lit(f"{track} is null"))))


def union(components: list[DataFrame]) -> DataFrame:
    """All components with their number; columns that one lacks are null there."""
    parts = [c.withColumn("component", F.lit(i)) for i, c in enumerate(components)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def set_problems(items: DataFrame) -> DataFrame:
    """(problem): ids in several components, and labels that don't occur."""
    twice = items.groupBy("item_id").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0").select(F.format_string("%d ids more than once", "n").alias("problem"))
    labels = items.agg(*(F.count_if(F.col("label") == x).alias(x) for x in ("real", "fake")))
    none = labels.select(F.explode(F.filter(F.array(*(F.when(F.col(x) == 0, F.lit(f"no {x} items")) for x in ("real", "fake"))), lambda x: x.isNotNull())).alias("problem"))
    return twice.unionByName(none)


def subset(df: DataFrame, per_stratum: int, strata: list[str], seed: int = 0, key: str = "item_id") -> DataFrame:
    """The first rows of each stratum by hash rank. Nulls are a stratum; a larger subset contains a smaller one."""
    order = Window.partitionBy(*strata).orderBy(hash_rank(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_stratum).drop("_n")
