"""Score parts as a stream: an exactly-once append of items that aren't scored yet. The stream is this library's own way to
resume; batches end where a micro-batch ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import read_scores


def score_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str = "item_id") -> StreamingQuery:
    """Scores the Parquet files that arrive in ``source``. Items that ``out`` has already are skipped, so a batch that is
    run again after a failure adds nothing twice. ``out`` must exist."""

    def batch(items: DataFrame, _: int) -> None:
        todo = items.dropDuplicates([key]).join(read_scores(spark, out).select(key), key, "left_anti")
        score(todo).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
