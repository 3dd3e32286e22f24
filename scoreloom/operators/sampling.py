"""Deterministic samples by hash rank, and hash shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_rank, shard_of
from .quantiles import BROADCAST_ROWS, SMALL, least_ranks
from .settle import settle


class NoCandidates(ValueError):
    """A wanted label has no row at all."""


def _number(rank: Column) -> Column:
    """The first 52 bits of a hexadecimal hash, which a double holds."""
    return F.conv(F.substring(rank, 1, 13), 16, 10).cast("long").cast("double")


def _among_first(df: DataFrame, count: int, strata: list[str], seed: int, key: str, small: int = SMALL) -> DataFrame:
    """``df`` with _first: whether a row is among the ``count`` of its stratum with the least hash. The last of these is found
    by counting, so no stratum is sorted; only rows whose hash begins like the last one's are put in order."""
    rank = hash_rank(seed, key)
    if count < 1:
        return df.withColumn("_first", F.lit(False))
    last = least_ranks(df.withColumn("_rank", rank), strata, _number(F.col("_rank")), count, small)
    last = settle(last.select(F.col("k").alias("_s"), F.col("last").alias("_last"), F.col("below").alias("_below")))
    rows = df.withColumns({"_k": F.struct(*strata), "_rank": rank, "_u": _number(rank)})
    table = F.broadcast(last) if last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last
    rows = rows.join(table, F.col("_k") == F.col("_s"), "left")  # strata of fewer rows are not in the table
    tied = F.coalesce(F.col("_u") == F.col("_last"), F.lit(False))
    ahead = rows.where(~tied).withColumn("_first", F.col("_last").isNull() | (F.col("_u") < F.col("_last")))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_rank", key))
    level = rows.where(tied).withColumn("_first", place <= F.lit(count) - F.col("_below"))
    return ahead.unionByName(level).select(*df.columns, "_first")


def choose(df: DataFrame, per_stratum: int, stratum: str, seed: int = 0, key: str = "rel_path", labels: tuple[str, ...] = ("real", "fake")) -> DataFrame:
    """The first rows by hash of each of ``labels`` and stratum, real rows first; rows with another label or none are left
    out. Raises NoCandidates if a label has no row."""
    wanted = [x for x in ("real", "fake") if x in labels]
    rows = df.where(F.col("label").isin(wanted))
    have = {r[0] for r in rows.select("label").distinct().collect()}  # two at most
    if missing := [x for x in wanted if x not in have]:
        raise NoCandidates(f"no {' or '.join(missing)} items among the candidates")
    rank = hash_rank(seed, key)
    rows = _among_first(rows, per_stratum, ["label", stratum], seed, key).where("_first").drop("_first").withColumn("_rank", rank)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("label", stratum).orderBy("_rank", key)))
    return rows.orderBy(F.col("label") == "fake", stratum, "_rank").drop("_rank")


def pick_balanced(df: DataFrame, n: int, seed: int = 0, key: str = "item_id") -> DataFrame:
    """``n`` rows, half of each label; what one label lacks the other gives."""
    rows = df.withColumn("_rank", hash_rank(seed, key)).withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("_rank", key)))
    rows = rows.where(F.col("_n") <= n)  # a fixed bound, so each task keeps no more than that before the shuffle
    have = df.agg(F.count_if(F.col("label") == "real").alias("r"), F.count_if(F.col("label") == "fake").alias("f"))
    real = F.least(F.col("r"), F.greatest(F.lit(n // 2), F.lit(n) - F.col("f")))
    quota = have.select(F.explode(F.array(F.struct(F.lit("real").alias("label"), real.alias("q")), F.struct(F.lit("fake").alias("label"), F.least(F.col("f"), F.lit(n) - real).alias("q")))).alias("x")).select("x.*")
    return rows.join(F.broadcast(quota), "label").where(F.col("_n") <= F.col("q")).drop("_n", "_rank", "q")


def mark(df: DataFrame, cap: int, strata: list[str], seed: int = 0, key: str = "item_id") -> DataFrame:
    """``df`` with ``sampled``: whether a row is among the first ``cap`` of its stratum."""
    return _among_first(df, cap, strata, seed, key).withColumnRenamed("_first", "sampled")


def shards(df: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(key), n))
