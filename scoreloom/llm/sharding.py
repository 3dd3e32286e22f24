"""Shards of near-equal bytes by sampled splitters, with DataFrame operations only.

Keys are hashes of the text, so equal texts stand together and share a shard as long as their group is no larger than a
range. Key samples are drawn with a chance in proportion to the row's size; their quantiles bound ``ranges`` key ranges;
ranges that turn out overfull, in bytes or in rows (one key may hold a third of everything), are subdivided by a hash of
the document; parts that are overfull still, which rows that repeat both id and text make, are subdivided by a number of
the row; and consecutive parts fill the shards by their measured bytes.

Nulls and odd cases: a null text has no bytes (size 1) and CRC 0; a null doc_id is kept; repeated rows each get a slot,
and are divided among shards like any others where they are many; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage

#: Expected sample size, whatever the input's size.
SAMPLE = 65_536
#: Key ranges; a shard is off by about one of them at most.
RANGES = 4_096
_PREFIX_BITS = 16


def _splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> DataFrame:
    """(cut): upper bounds of key ranges, at most ``ranges`` rows."""
    chance = F.col("size") * F.lit(sample / max(total, 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "tie", "h"), 11) / F.lit(float(1 << 53))
    tile = F.ntile(ranges).over(Window.orderBy("h"))  # over the bounded sample
    return rows.where(draw < chance).select("h", tile.alias("tile")).groupBy("tile").agg(F.max("h").alias("cut")).select("cut").distinct()


def _range_map(splitters: DataFrame) -> DataFrame:
    """For each key prefix: how many cuts lie below it, and the cuts in it. 2^16 rows, whatever the input's size."""
    spark = splitters.sparkSession
    own = splitters.groupBy(F.shiftrightunsigned("cut", 63 - _PREFIX_BITS).alias("prefix")).agg(F.collect_list("cut").alias("cuts"))
    every = spark.range(1 << _PREFIX_BITS).withColumnRenamed("id", "prefix").join(own, "prefix", "left")
    every = every.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("prefix", "cuts", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)).alias("base"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs``."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
    )
    rows = rows.withColumns({"tie": F.xxhash64("doc_id", "text_crc32"), "row": F.monotonically_increasing_id()})
    rows = cut_lineage(rows)  # fixes the rows' numbers
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    cuts = F.broadcast(_range_map(_splitters(rows, total, ranges, sample)))
    rows = rows.withColumn("prefix", F.shiftrightunsigned("h", 63 - _PREFIX_BITS)).join(cuts, "prefix")
    below = F.size(F.filter("cuts", lambda c: c < F.col("h")))
    rows = rows.withColumn("range", (F.col("base") + below).cast("int")).drop("prefix", "cuts", "base")

    fill = F.greatest(F.col("b") / F.lit(2.0 * max(total, 1) / ranges), F.col("r") / F.lit(2.0 * max(n, 1) / ranges))
    parts = F.greatest(F.ceil(fill), F.lit(1)).cast("int")

    def divided(rows: DataFrame, by: list[str], tie: Column, into: str) -> DataFrame:
        """``rows`` with a part of their group, as many parts as make it no fuller than two ranges."""
        stats = rows.groupBy(*by).agg(F.sum("size").alias("b"), F.count("*").alias("r"))
        small = F.broadcast(stats.select(*by, parts.alias("parts")))  # at most three parts for each range on average
        return rows.join(small, by).withColumn(into, F.pmod(tie, F.col("parts")).cast("int")).drop("parts")

    rows = divided(rows, ["range"], F.col("tie"), "part")
    rows = cut_lineage(divided(rows, ["range", "part"], F.xxhash64("tie", "row"), "sub"))

    place = ["range", "part", "sub"]
    stats = rows.groupBy(*place).agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    upto = F.sum("b").over(Window.orderBy(*place)) - F.col("b") / 2
    stats = stats.withColumn("shard", F.least(F.lit(shards - 1), F.floor(upto * shards / F.lit(max(total, 1)))).cast("int"))
    first = F.sum("r").over(Window.partitionBy("shard").orderBy(*place)) - F.col("r")
    places = F.broadcast(stats.select(*place, "shard", first.alias("first")))

    within = F.row_number().over(Window.partitionBy(*place).orderBy("h", "tie", "doc_id", "row")) - 1
    out = rows.withColumn("within", within).join(places, place)
    slot = (F.col("first") + F.col("within")).cast("long").alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
