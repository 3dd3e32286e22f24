"""A cache of detections that a restarted run needn't shuffle: one table, partitioned by the detector's settings and bucketed
by item, so that looking up which items it has moves the items alone.

Rows of other settings are never seen. An item is flushed whole; rows without an item are refused by the lookup, since no
item equals null. ``replace`` rewrites the rows of one settings, and no other partition.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "settings"


def settings_key(settings: dict) -> str:
    """Equal settings, equal key, in whatever order they are given."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


class DetectionCache:
    """Table ``name`` at ``path``; ``schema`` of a row without its settings, ``key`` among it."""

    def __init__(self, spark: SparkSession, name: str, path: str, schema: str, settings: dict, key: str = "item_id", buckets: int = 64) -> None:
        self.spark, self.name, self.key, self.settings = spark, name, key, settings_key(settings)
        if not spark.catalog.tableExists(name):
            fields = f"{schema}, {SETTINGS} string"
            spark.sql(f"create table if not exists {name} ({fields}) using parquet partitioned by ({SETTINGS}) clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
        self.columns = spark.table(name).columns

    def load(self) -> DataFrame:
        """What was found under these settings."""
        return self.spark.table(self.name).where(F.col(SETTINGS) == self.settings).drop(SETTINGS)

    def todo(self, items: DataFrame) -> DataFrame:
        """``items`` that the cache doesn't have yet."""
        return items.join(self.load().select(self.key), self.key, "left_anti")

    def _rows(self, found: DataFrame) -> DataFrame:
        return found.withColumn(SETTINGS, F.lit(self.settings)).select(self.columns)

    def flush(self, found: DataFrame) -> None:
        """Adds the rows of items that the cache doesn't have; the file committer makes them visible at once."""
        self._rows(self.todo(found)).write.mode("append").insertInto(self.name)

    def replace(self, found: DataFrame) -> None:
        """These settings' rows alone are exchanged for ``found``, which must not read them."""
        fields = ", ".join(f"`{c}`" for c in self.columns if c != SETTINGS)
        self.spark.sql(f"insert overwrite table {self.name} partition ({SETTINGS} = '{self.settings}') select {fields} from {{found}}", found=found)
