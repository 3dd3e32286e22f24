"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and the bytes 9 to 13. bytes.split() splits at exactly these.
WHITE_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a fresh local one only where that
    is unset and one machine runs everything, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scoreloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Seconds between two times that files of finished steps are given back.
RELEASE_EVERY_S = 3.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing refers to any more. It finds them when the driver collects
    garbage, which a driver with room to spare does far too late for a job of many rounds."""
    global _released  # noqa: PLW0603
    if time.monotonic() - _released > RELEASE_EVERY_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # noqa: SLF001
        _released = time.monotonic()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    shared_folder(frame.sparkSession)
    release(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table that is written to the shared folder and read back, which also cuts its lineage; columnar and
    compressed, so better than a checkpoint for whole texts."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    release(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def map_batches(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a size guard: empty batches never reach ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(b for b in batches if b.num_rows)

    return frame.mapInArrow(run, schema)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"  # noqa: PLW2901
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``frame`` with each row's place, from 0, in ``order``, which should leave no long ties. Rows are range-partitioned and
    checkpointed; places are counted inside the ranges and over them, so nothing is sorted in one task."""
    (part,) = free_names(frame, "part")
    rows = cut_lineage(frame.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = rows.groupBy(part).agg(F.count("*").alias("rows_in_part"))  # a row for each range
    before = F.sum("rows_in_part").over(Window.orderBy(part)) - F.col("rows_in_part")
    starts = F.broadcast(sizes.select(F.col(part).alias("_of"), before.alias("_before")))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    placed = rows.withColumn(name, local).join(starts, F.col(part) == F.col("_of"))
    return placed.withColumn(name, F.col(name) + F.col("_before")).select(*frame.columns, name)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def clean(spark: SparkSession, older_than: float = 86_400.0, kinds: tuple[str, ...] = ("chunks", "media", "near-dedup", "packed", "pipeline", "trie", "warc")) -> list[str]:
    """Removes what operators and the pipeline wrote to the shared folder, if it is older than so many seconds; to the names.
    A result that still reads from such a folder is lost, so this is for when results are written elsewhere."""
    folder = shared_folder(spark)
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    ours = re.compile(rf"({'|'.join(map(re.escape, kinds))})-[0-9a-f]{{32}}")
    old = [f for f in found if f.type == fs.FileType.Directory and ours.fullmatch(f.base_name) and time.time() - f.mtime_ns / 1e9 > older_than]
    for f in old:
        store.delete_dir(f.path)
    return sorted(f.base_name for f in old)
