"""Registries kept as one YAML or JSON file for each entry, named by the entry's id.

YAML needs the ``yaml`` package on the executors; JSON, which is YAML too, is read without it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parsed(text: str) -> str:
    """The file's content as JSON: an object with its fields, or with an error alone."""
    try:
        try:
            value = json.loads(text)
        except ValueError:
            import yaml  # noqa: PLC0415

            value = yaml.safe_load(text)
    except Exception as e:  # noqa: BLE001  # whatever a parser says is the file's problem
        return json.dumps({"error": f"{type(e).__name__}"})
    return json.dumps(value, default=str) if isinstance(value, dict) else json.dumps({"error": "not a mapping"})


def files(spark: SparkSession, folder: str, suffix: str = "yaml") -> DataFrame:
    """(stem, body, names): the entries of a folder, each body as JSON, with the names of its fields."""
    rows = spark.read.text(f"{folder.rstrip('/')}/*.{suffix}", wholetext=True)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{suffix}$", 1).alias("stem"), "value")

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            bodies = [_parsed(t) for t in b["value"]]
            yield pd.DataFrame({"stem": b["stem"], "body": bodies, "names": [sorted(json.loads(x)) for x in bodies]})

    return rows.mapInPandas(work, "stem string, body string, names array<string>")


def problems(entries: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """(stem, problem) for files that can't be read, whose id isn't their name, or whose fields aren't as they must be."""
    known = F.array(*(F.lit(n) for n in ("error", *required, *optional)))
    own = F.get_json_object("body", "$.id")
    missing = F.array_except(F.array(*(F.lit(n) for n in required)), F.col("names"))
    unknown = F.array_except(F.col("names"), known)
    listed = lambda c: F.array_join(F.array_sort(c), ", ")
    broken = F.get_json_object("body", "$.error")
    found = F.array_compact(
        F.array(
            F.when(broken.isNotNull(), F.concat(F.lit("unreadable: "), broken)),
            F.when(broken.isNull() & ~own.eqNullSafe(F.col("stem")), F.concat(F.lit("id is "), F.coalesce(own, F.lit("missing")), F.lit(", not the file's name"))),
            F.when(broken.isNull() & (F.size(missing) > 0), F.concat(F.lit("missing fields "), listed(missing))),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), listed(unknown))),
        )
    )
    return entries.select("stem", F.explode(found).alias("problem"))


def registry(spark: SparkSession, folder: str, schema: str, required: list[str], suffix: str = "yaml") -> DataFrame:
    """The entries of a folder as rows of ``schema`` (DDL, with id); raises if any file has a problem."""
    entries = files(spark, folder, suffix)
    row = F.from_json("body", schema)
    columns = entries.select(row.alias("row")).select("row.*").columns
    wrong = problems(entries, required, [c for c in columns if c not in required]).orderBy("stem", "problem").limit(50).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['stem']}: {r['problem']}" for r in wrong))
    return entries.select(row.alias("row")).select("row.*")
