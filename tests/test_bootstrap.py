"""The bootstrap by hash reads its rows once for their ranks, however many replicates there are."""

from pyspark.sql import functions as F

from scoreloom.operators import metrics


def test_rows_are_made_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(400).select(F.concat(F.lit("i"), "id").alias("item_id"), F.when(F.col("id") % 3 == 0, "fake").otherwise("real").alias("label"), (F.col("id") % 17).cast("double").alias("score"), F.lit("ok").alias("status"))
    assert len(metrics.hash_bootstrap(rows.mapInPandas(counted, rows.schema), 5).collect()) == 5
    assert seen.value <= 800
