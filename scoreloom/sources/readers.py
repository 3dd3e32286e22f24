"""Sources: item tables, score parts, protocol files, rows of shards, path listings, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("status", T.StringType()), T.StructField("load_s", T.DoubleType()), T.StructField("infer_s", T.DoubleType())])
RUN_RECORD = "run_id string, model string, evalset string, hashes map<string,string>, sessions array<struct<started:string,device:string,host:string,dirty:boolean>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All score parts of a folder. Columns that older parts lack are null; no parts at all give an empty typed table.
    ``folder`` itself must exist."""
    return spark.read.schema(SCORES).option("pathGlobFilter", "part-*.parquet").parquet(folder)


def read_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Columns of Parquet shards with the row's number in its file, or the number stored with it."""
    df = spark.read.parquet(folder)
    number = F.col("_metadata.row_index")
    stored = F.coalesce("__source_row", number) if "__source_row" in df.columns else number
    return df.select(*columns, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"), stored.alias("source_row"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) below a folder, without hidden files, as a Spark scan that reads no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def protocol(lines: DataFrame, fields: int = 5) -> DataFrame:
    """``lines(value)`` split at white space; lines without exactly ``fields`` fields are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts.alias("f")).where(F.size("f") == fields)


def unquoted_tsv(lines: DataFrame, least: int = 2) -> DataFrame:
    """Tab-separated lines whose quote characters are text."""
    return lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= least)


def read_records(spark: SparkSession, path: str, schema: str = RUN_RECORD) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
