"""Cutting lineage where executors may be lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, that of ``spark.checkpoint.dir``; where that is unset, a fresh one
    if one machine runs everything, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scoreloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared(frame.sparkSession)
    return frame.checkpoint(eager=True)
