"""Selection of runs for status, archive and publication tables, and the site's grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """One run for each model and set: the one that started last, of equal ones that of the first source. Only runs count
    whose configuration hash is accepted, and that may be published."""
    rows = runs.where(publish_refusal(F.col("role"), F.col("evalset"), F.col("namespace")).isNull())
    if accepted is not None:
        rows = rows.join(accepted, ["model", "config_hash"], "left_semi")
    order = Window.partitionBy("model", "evalset").orderBy(F.col("started").desc(), "source_rank", "run_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def publish_refusal(role: Column, evalset: Column, namespace: Column) -> Column:
    """Why a run may not be published, or null."""
    return F.when(role == "pipeline_test", F.concat(evalset, F.lit(" is a pipeline test"))).when(namespace.isNotNull(), F.concat(F.lit("namespace "), namespace, F.lit(" holds pipeline tests")))


def private_columns(df: DataFrame) -> list[str]:
    """Columns that name single items: a table that has one is never published."""
    return [c for c in df.columns if c in ("item_id", "rel_path", "subject_id", "source_subject_id")]


def run_flags(runs: DataFrame, parity: DataFrame) -> DataFrame:
    """(run_id, flags): an array of short remarks for each run, in order of weight; empty for a run without any."""
    directed = runs.where("role = 'reproduction' and auc > 0.5").select("model").distinct().withColumn("directed", F.lit(True))
    rows = runs.join(parity.where("passed").select("model").distinct().withColumn("checked", F.lit(True)), "model", "left").join(directed, "model", "left")
    tests = [
        F.when(F.col("verdict") != "clean", F.replace("verdict", F.lit("_"), F.lit(" "))),
        F.when(F.col("pairing") == "cross_corpus", F.lit("cross-corpus")),
        F.when(F.col("checked").isNull(), F.lit("no parity check")),
        F.when(F.col("directed").isNull(), F.lit("score direction unchecked")),
        F.when(F.col("auc") < 0.5, F.lit("below chance")),
        F.when(F.col("unscored_items") > 0, F.concat(F.col("unscored_items").cast("string"), F.lit(" unscored"))),
    ]
    return rows.select("run_id", F.array_join(F.filter(F.array(*tests), lambda x: x.isNotNull()), "; ").alias("flags"))


def cell_matrix(accepts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(model, evalset, state): na where the model can't read the set, guard where its verdict forbids it; others are left
    out. ``accepts`` has a row for each pair."""
    rows = accepts.join(verdicts.select("model", "evalset", "verdict"), ["model", "evalset"], "left")
    state = F.when(~F.col("accepted"), "na").when(F.col("verdict") == "contaminated", "guard")
    return rows.select("model", "evalset", state.alias("state")).where("state is not null")


def result_grid(accepts: DataFrame, cells: DataFrame, latest: DataFrame, models: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each model, a column for each set: run, trained (guarded), na, off (``models(model, adapter)`` has no
    adapter), pending (``sets(evalset, ready)`` isn't there yet) or todo."""
    rows = accepts.join(cells, ["model", "evalset"], "left").join(latest.select("model", "evalset", "run_id"), ["model", "evalset"], "left")
    rows = rows.join(models, "model").join(sets, "evalset")
    kind = F.when(F.col("run_id").isNotNull(), "run").when(F.col("state") == "guard", "trained").when(F.col("state") == "na", "na")
    kind = kind.when(~F.col("adapter"), "off").when(~F.col("ready"), "pending").otherwise("todo")
    return rows.select("model", "evalset", kind.alias("kind")).groupBy("model").pivot("evalset", columns).agg(F.first("kind"))


def archive_index(runs: DataFrame, records: DataFrame, published: DataFrame, restricted: DataFrame) -> DataFrame:
    """An index row for each archived run, from nested JSON; runs of restricted lineage are left out."""
    kept = runs.join(restricted.where("restricted").select("run_id"), "run_id", "left_anti")
    rows = kept.join(records, "run_id", "left").join(published.select("run_id").distinct().withColumn("published", F.lit(True)), "run_id", "left")
    js = lambda path: F.get_json_object("summary", path)
    return rows.select("run_id", js("$.model").alias("model"), js("$.overall.n").cast("long").alias("n"), js("$.overall.auc").cast("double").alias("auc"), js("$.compute.env.gpu").alias("gpu"), F.coalesce("published", F.lit(False)).alias("published"))


def provenance(sessions: DataFrame) -> DataFrame:
    """(run_id, first_started, last_started, devices, dirty): sessions of a run without their hosts."""
    device = F.array_join(F.array_sort(F.collect_set("device")), ",")
    return sessions.groupBy("run_id").agg(F.min("started").alias("first_started"), F.max("started").alias("last_started"), device.alias("devices"), F.coalesce(F.bool_or("dirty"), F.lit(False)).alias("dirty"), F.count("*").alias("sessions"))


def siblings(df: DataFrame, name: str, within: str) -> DataFrame:
    """``df`` with the names before and after a row in its group."""
    w = Window.partitionBy(within).orderBy(name)
    return df.withColumns({"previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def run_lengths(df: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """(within, run, value, n, first): successive rows with one value are a run."""
    w = Window.partitionBy(within).orderBy(order)
    change = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))) | (F.row_number().over(w) == 1), F.lit(True)).cast("int")
    rows = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    return rows.groupBy(within, "run", value).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def recorded(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, feature): which columns hold any value."""
    have = df.groupBy(by).agg(*((F.count(c) > 0).alias(c) for c in columns))
    return have.unpivot([by], columns, "feature", "there").where("there").drop("there")


def grid_columns(sets: DataFrame) -> DataFrame:
    """Sets with their place in the grid: reproductions last, then scored before unscored, then by size and name."""
    order = Window.orderBy(F.when(F.col("role") == "reproduction", 1).otherwise(0), F.when(F.col("runs") > 0, 0).otherwise(1), F.col("items").desc(), "evalset")
    return sets.withColumn("place", F.row_number().over(order))
