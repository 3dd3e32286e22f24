"""Sinks: score parts, group tables, guarded publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.status import private_columns


def append_scores(scores: DataFrame, folder: str) -> None:
    """Adds parts; the file committer makes them visible at once."""
    scores.write.mode("append").parquet(folder)


def resume(items: DataFrame, folder: str) -> DataFrame:
    """Items that no part of the folder has yet."""
    from .readers import read_scores

    return items.join(read_scores(items.sparkSession, folder).select("item_id"), "item_id", "left_anti")


def write_groups(groups: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    publish_guard(groups)
    groups.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    publish_guard(summary)
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def publish_guard(df: DataFrame) -> None:
    """Refuses tables that name single items."""
    found = private_columns(df)
    if found:
        raise PermissionError(f"not published: {', '.join(found)} name single items")
