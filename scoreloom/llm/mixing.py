"""Mixing sources to target weights along a time-varying curriculum.

Each source, in code point order with null last, gets the next of the repeating ``weights``; together they are to give
``share`` of all words. No source gives more than ``cap`` times its words; what that leaves over is shared again by
weight among the rest, which has a closed form: all sources that are not capped have the same words for each unit of
weight. A source's schedule is a weight that changes in a line from the start of the training run (time 0) to its end
(time 1); its integral up to a time is the share of the target that is due by then. Documents of a source follow each
other in the order of a hash; the words before a document, put through the inverse of that integral, give its training
position, and the result is range-sorted by position. A source that gives more words than it has goes through its
documents again. The last document that a source gives may be taken in part, so each source meets its target to the word.

The hash is of id and text, so neither rows without an id nor those that share one follow each other. Sources may be many:
they are ranked in ranges, and the level of words for each unit of weight is found by Newton's method on sums over all.

Nulls and odd cases: a null text has no words; a null source is a source of its own; rows that repeat an id and a text
follow each other in any order; sources without words have target 0; documents that are not taken have no position and
come last; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, cut_lineage, numbered

WEIGHTS = (5, 2, 1)
#: Relative weight at time 0 and at time 1, repeating as the weights do.
RAMPS = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
SHARE = 1.5
CAP = 2


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(source, skey, source_size)``, a row for each source, with its target and schedule (begin, end)."""
    rows = numbered(sizes, [F.col("source").asc_nulls_last()], "place").withColumn("rank", F.col("place") + 1)
    ramp = (_cycle(tuple(r[i] for r in ramps), F.col("rank")).alias(name) for i, name in enumerate(("begin", "end")))
    rows = cut_lineage(rows.select("skey", "source_size", _cycle(weights, F.col("rank")).alias("w"), *ramp))
    limit = F.col("source_size") * F.lit(float(cap))
    total = F.sum("source_size") * F.lit(float(share))
    # what min(limit, level * w) gives over all sources is concave in level, so Newton's steps from below never pass the root
    level, step = -1.0, 0.0
    while step is not None and step > level:
        level = step
        open_ = limit > F.lit(level) * F.col("w")
        bound = F.coalesce(F.sum(F.when(~open_, limit)), F.lit(0.0))
        step = rows.agg(F.try_divide(total - bound, F.sum(F.when(open_, F.col("w")))).alias("step")).first()["step"]
    target = limit if step is None else F.least(limit, F.lit(level) * F.col("w"))
    return rows.select("skey", "source_size", "begin", "end", target.alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` with its words, its source as a key that is never null, and its place in the order of a hash."""
    parts = (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]).cast("binary"))
    return docs.withColumns(
        {
            "_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
            "_skey": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
            "_key": key,
            "_bucket": F.substring(key, 1, 3),
        }
    )


def _starts(keyed: DataFrame, source_col: str, share: float, cap: int) -> DataFrame:
    """For each source and each of its 4,096 buckets of the order: the words before it, and the source's target."""
    buckets = keyed.groupBy("_skey", "_bucket").agg(F.first(source_col, ignorenulls=True).alias("source"), F.sum("_size").alias("b"))
    buckets = cut_lineage(buckets)
    sizes = buckets.groupBy(F.col("_skey").alias("skey")).agg(F.first("source", ignorenulls=True).alias("source"), F.sum("b").alias("source_size"))
    goal = targets(sizes, share=share, cap=cap).withColumnsRenamed({"skey": "_skey", "source_size": "_source_size", "target": "_target", "begin": "_begin", "end": "_end"})
    before = F.sum("b").over(Window.partitionBy("_skey").orderBy("_bucket")) - F.col("b")
    return buckets.select("_skey", "_bucket", before.alias("_start")).join(goal, "_skey")


def _placed(keyed: DataFrame, starts: DataFrame, cap: int) -> DataFrame:
    """Words taken of each row in each pass, and their training positions."""
    order = Window.partitionBy("_skey", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.withColumn("_within", F.sum("_size").over(order) - F.col("_size")).join(starts, ["_skey", "_bucket"])
    rows = rows.withColumn("_at", F.col("_start") + F.col("_within"))
    words, size, begin, end = F.round("_target").cast("long"), F.col("_size"), F.col("_begin"), F.col("_end")
    part = lambda p: F.greatest(F.lit(0), F.least(size, words - (F.col("_at") + p * F.col("_source_size"))))
    due = lambda x, p: (F.col("_at") + p * F.col("_source_size") + x / 2) / F.col("_target")
    # the inverse of the schedule's integral
    time = lambda q: q * (begin + end) / (begin + F.sqrt(begin * begin + (end * end - begin * begin) * q))
    rows = rows.withColumn("_parts", F.array(*(part(p) for p in range(cap))))
    spots = F.transform("_parts", lambda x, p: F.when(x > 0, F.struct(F.least(F.lit(1.0), time(due(x, p))).alias("position"), x.alias("words"))))
    return rows.withColumn("_spots", F.filter(spots, lambda x: x.isNotNull()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions, position), one row for each row of ``docs``, in the order of
    position. positions has one training position for each time that the document is taken, wholly or in part."""
    rows = _keyed(docs, id_col, text_col, source_col, seed).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "_size", "_skey", "_key", "_bucket")
    rows = cut_lineage(rows)
    rows = _placed(rows, _starts(rows, "source", share, cap), cap)
    taken = F.aggregate("_parts", F.lit(0).cast("long"), lambda s, x: s + x)
    positions = F.col("_spots.position")
    first = F.when(F.size("_spots") > 0, F.element_at(positions, 1))
    out = rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), positions.alias("positions"), first.alias("position"), "_key")
    return cut_lineage(out).orderBy(F.col("position").asc_nulls_last(), "_key").drop("_key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it. A document that is taken in part, the last
    of its source, is there if at least half of it is taken."""
    # the input's columns travel in one struct, so that no name of theirs can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    keyed = _keyed(packed, "id", "text", "source", seed).drop("id", "text")
    placed = _placed(keyed, _starts(keyed.select("source", "_size", "_skey", "_bucket"), "source", share, cap), cap)
    whole = F.filter("_spots", lambda x: 2 * x["words"] >= F.col("_size"))
    rows = placed.select("row", "_key", F.explode(whole).alias("_spot"))
    return rows.orderBy("_spot.position", "_key").select("row.*")
