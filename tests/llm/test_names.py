"""Columns of the input keep their values in every stage that returns documents, whatever their names."""

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import chunks, mixing, nearcopies, simhash, toxicity

NAMES = ["id", "th", "n", "row", "k", "label", "_id", "_th", "_n", "_size", "_skey", "_key", "_bucket", "_cuts", "_left", "_toxic", "_scored", "toxic_score", "scored", "size", "key", "cuts", "place"]


@pytest.mark.parametrize("stage", ["simhash", "nearcopies", "chunks", "mixing", "toxicity"])
def test_no_name_clashes(spark, stage):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "ab"[i % 2]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in NAMES})
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    work = {"simhash": simhash.keep_one_each, "nearcopies": nearcopies.keep_one_each, "chunks": chunks.without_repeats, "mixing": mixing.mixed_documents, "toxicity": lambda d: toxicity.keep_civil(d, labels)}
    out = work[stage](docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in NAMES) and (kept or stage == "toxicity")
