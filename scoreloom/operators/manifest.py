"""Item tables: schema, validation that reports every problem, summary and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import PLACEHOLDERS

REQUIRED = ("item_id", "dataset", "rel_path", "modality", "label")
OPTIONAL = ("method", "method_family", "language", "subject_id", "source_subject_id", "split", "duration_s", "label_video", "label_audio")
LABELS = ("real", "fake")
MODALITIES = ("video", "audio", "audio_video", "image")
SOURCES = ("dataset", "self_reported", "annotated", "inferred")
TRACKS = ("label_video", "label_audio")
#: The fixed part of an item table; any pairs of g_<name>, g_<name>_src may follow.
SCHEMA = T.StructType([T.StructField(c, T.StringType(), c not in REQUIRED) for c in REQUIRED] + [T.StructField(c, T.DoubleType() if c == "duration_s" else T.StringType()) for c in OPTIONAL])


def group_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("g_") and not c.endswith("_src")]


def _listing(c: str, allowed: tuple[str, ...]) -> Column:
    """The values of a column that aren't allowed, sorted."""
    return F.array_join(F.array_sort(F.collect_set(F.when(~F.col(c).isin(*allowed), F.col(c)))), ", ")


def problems(df: DataFrame, dataset: str) -> DataFrame:
    """(problem): a row for each broken rule, found in one pass over the rows and one over the ids."""
    spark = df.sparkSession
    names = [f"missing column {c}" for c in REQUIRED if c not in df.columns]
    if names:
        return spark.createDataFrame([(n,) for n in names], "problem string")
    names = [f"unexpected column {c}: attributes need the g_ prefix" for c in df.columns if c not in REQUIRED + OPTIONAL and not c.startswith("g_")]
    rules: list[tuple[Column, Column]] = []  # (broken, text)
    some = lambda test, text: rules.append((F.count_if(test) > 0, F.lit(text)))
    some(F.col("item_id").isNull(), "item_id must be present and unique")
    some(~F.col("item_id").startswith(f"{dataset}/"), f"every item_id must start with {dataset}/")
    some(~F.col("dataset").eqNullSafe(dataset), f"dataset must be {dataset} throughout")
    some(F.col("label").isNull(), "label must not be null")
    for c, allowed, text in (("label", LABELS, "label must be real or fake, found "), ("modality", MODALITIES, "unknown modalities ")):
        found = _listing(c, allowed)
        rules.append((found != "", F.concat(F.lit(text), found)))
    tracks = [c for c in TRACKS if c in df.columns]
    for c in tracks:
        found = _listing(c, LABELS)
        rules.append((found != "", F.concat(F.lit(f"track {c} must be real, fake or null, found "), found)))
    if tracks:
        any_fake = F.greatest(*(F.coalesce(F.col(c) == "fake", F.lit(False)).cast("int") for c in tracks), F.lit(0)) == 1
        some(any_fake & ~F.col("label").eqNullSafe("fake"), "an item with a fake track must have label fake")
    if len(tracks) == len(TRACKS):
        some((F.col(TRACKS[0]) == "real") & (F.col(TRACKS[1]) == "real") & ~F.col("label").eqNullSafe("real"), "an item whose tracks are all real must have label real")
    for c in group_columns(df):
        src = f"{c}_src"
        if src not in df.columns:
            names.append(f"{c} needs a {src} column")
            continue
        found = _listing(src, SOURCES)
        rules.append((found != "", F.concat(F.lit(f"{src} has unknown sources "), found)))
        some(F.col(c).isNotNull() & F.col(src).isNull(), f"{src} must be set wherever {c} has a value")
        some(F.lower(F.col(c).cast("string")).isin(*PLACEHOLDERS), f"{c} uses a placeholder; use null for unknown")
    names += [f"{c} has no matching attribute" for c in df.columns if c.endswith("_src") and c.removesuffix("_src") not in df.columns]
    found = df.agg(F.array(*(F.when(test, text) for test, text in rules)).alias("p")).select(F.explode("p").alias("problem")).where("problem is not null")
    twice = df.groupBy("item_id").count().where("count > 1 and item_id is not null").limit(1).select(F.lit("item_id must be present and unique").alias("problem"))
    return found.unionByName(twice).unionByName(spark.createDataFrame([(n,) for n in names], "problem string")).distinct()


def summarise(df: DataFrame) -> DataFrame:
    """(attribute, value, label, n): counts by label, and by each attribute's values (<null> among them) and label."""
    pairs = F.array(F.struct(F.lit("label").alias("attribute"), F.lit("*").alias("value")), *(F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in group_columns(df)))
    return df.select("label", F.explode(pairs).alias("p")).groupBy("p.attribute", "p.value", "label").agg(F.count("*").alias("n"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows, and a hash of all (item_id, label) pairs that doesn't depend on their order.

    The digest of one sorted text needs all its lines in one place: this is for item tables that fit a task.
    ``ranged_hash`` serves the same purpose for tables of any size."""
    pairs = F.array_sort(F.collect_list(F.struct("item_id", "label")))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["item_id"], F.lit("\t"), x["label"], F.lit("\n"))), "")
    return df.agg(F.count("*").alias("rows"), F.sha2(text, 256).alias("content_hash"))


def wide_hash(df: DataFrame) -> DataFrame:
    """One row: rows, and an order-independent hash that combines on the way, for tables of any size."""
    h = F.xxhash64("item_id", "label")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))


def ranged_hash(df: DataFrame, digits: int = 3) -> DataFrame:
    """One row: rows, and a hash of all (item_id, label) pairs that doesn't depend on their order, for tables of any size: the
    pairs are sorted and hashed in 16^``digits`` parts of a hash of the id, and the parts' digests, in order, are hashed."""
    line = F.concat("item_id", F.lit("\t"), "label", F.lit("\n"))
    parts = df.select(F.substring(F.sha1("item_id"), 1, digits).alias("part"), F.struct("item_id", "label", line.alias("line")).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["line"]), "")
    parts = parts.groupBy("part").agg(F.count("*").alias("n"), F.sha2(text, 256).alias("digest"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    return parts.agg(F.sum("n").alias("rows"), F.sha2(every, 256).alias("ranged_hash"))


def write(df: DataFrame, dataset: str, path: str) -> None:
    """Validates, then writes the table in the order of item_id."""
    found = [r["problem"] for r in problems(df, dataset).limit(50).collect()]
    if found:
        raise ValueError(f"{dataset}: " + "; ".join(sorted(found)))
    df.repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(path)
