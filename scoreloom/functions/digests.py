"""Canonical JSON, hashes of configurations, and digests of files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that Spark's own reader takes whole, and that a task reads at a time beyond that.
WHOLE, CHUNK = 1 << 28, 1 << 20


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, without spaces, all but ASCII escaped; of a key that repeats the last value; null where the
    text is null or no JSON. Numbers are written as Python writes them, which Spark's writer doesn't."""
    return text.map(_canonical)


def config_hash(text: Column) -> Column:
    """SHA-256 of JSON text, whatever the order of its keys and its spaces."""
    return F.sha2(canonical_json(text), 256)


def row_hash(*columns: str) -> Column:
    """The same of some columns as one object, nulls included."""
    return config_hash(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of the files below ``folder``. Small ones are read by Spark, from wherever it can read; larger
    ones in chunks by the tasks, from stores that Arrow knows, so none has to fit in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                digest = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while part := f.read(CHUNK):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield b.assign(sha256=found)

    # the contents aren't read for this list
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path")
    found = small.unionByName(large.mapInPandas(work, "path string, length long, sha256 string"))
    # Spark's scans leave out empty files, its listing doesn't
    listed = spark.createDataFrame([(re.sub("^([a-z0-9]+):///", r"\1:/", p),) for p in files.inputFiles()], "path string")
    empty = F.sha2(F.lit(b""), 256)
    return listed.join(found, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("sha256", empty).alias("sha256"))
