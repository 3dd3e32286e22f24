"""Catalogue operators: listing patterns, newest files, wall times, sizes, default sets, holdings, published differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing_patterns(sources: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``sources(dataset, base array, by_language map)`` to (dataset, pattern): the base patterns and those of the wanted
    languages (all, if none are named). A language without patterns is an error for a dataset that has any."""
    langs = F.array(*(F.lit(x) for x in wanted)) if wanted else F.map_keys("by_language")
    unknown = F.array_except(langs, F.map_keys("by_language"))
    chosen = F.flatten(F.transform(langs, lambda x: F.try_element_at("by_language", x)))
    checked = F.when(F.size("by_language") == 0, F.array().cast("array<string>")).when(F.size(unknown) > 0, F.raise_error(F.concat(F.col("dataset"), F.lit(": no patterns for "), F.array_join(unknown, ", "))).cast("array<string>")).otherwise(chosen)
    return sources.select("dataset", F.explode(F.concat("base", checked)).alias("pattern"))


def newest_files(listing: DataFrame) -> DataFrame:
    """``listing(path, store, store_rank, modified)`` to one row for each path, from the store that changed it last (the first of equal)."""
    return listing.groupBy("path").agg(F.max_by(F.struct("store", "modified"), F.struct("modified", -F.col("store_rank"))).alias("f")).select("path", "f.store", "f.modified")


def run_wall(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """``parts(run_id, modified, n_windows)``, ``sessions(run_id, started)`` in seconds: (run_id, wall_s, windows), from the
    first session's start to the last part."""
    p = parts.groupBy("run_id").agg(F.max("modified").alias("last"), F.sum("n_windows").alias("windows"))
    s = sessions.groupBy("run_id").agg(F.min("started").alias("first"))
    return p.join(s, "run_id").select("run_id", F.bround(F.col("last") - F.col("first")).cast("long").alias("wall_s"), "windows")


def last_folder(listing: DataFrame) -> DataFrame:
    """``listing(model, folder, modified)``: each model's folder that changed last."""
    return listing.groupBy("model").agg(F.max_by("folder", F.struct("modified", "folder")).alias("folder"))


def set_sizes(items: DataFrame, counted: DataFrame) -> DataFrame:
    """``items(evalset, item_id)``, ``counted(evalset, run_id, windows)``: items of each set, and the window count that any
    run has made (that of the first run that has one)."""
    n = items.groupBy("evalset").agg(F.count("*").alias("items"))
    w = counted.where("windows > 0").groupBy("evalset").agg(F.min_by("windows", "run_id").alias("windows"))
    return n.join(w, "evalset", "left")


def default_sets(candidates: DataFrame) -> DataFrame:
    """``candidates(model, model_modality, evalset, modality, position, datasets array)``: of sets over the same data one, that
    of the model's own modality if there is one, else the first."""
    data = F.array_sort(F.array_distinct("datasets"))
    order = Window.partitionBy("model", data).orderBy(F.when(F.col("modality") == F.col("model_modality"), 0).otherwise(1), "position")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("model", "evalset")


def smallest_archives(archives: DataFrame) -> DataFrame:
    """``archives(label, size, member)``: the smallest archive of each label, the first name of equal ones."""
    return archives.groupBy("label").agg(F.min(F.struct("size", "member")).alias("a")).select("label", "a.member", "a.size")


def published_difference(ours: Column, published: Column) -> Column:
    """Signed text of two percentages' difference: ± within half a hundredth, a dot where one is missing."""
    d = ours - published
    sign = F.when(d > 0.005, "+").when(d < -0.005, "−").otherwise("±")
    return F.when(d.isNull(), "·").otherwise(F.concat(sign, F.format_string("%.2f", F.abs(d))))


def holding(recorded: Column, status: Column, held: Column, languages: Column) -> Column:
    """What is there of a data set: full (with its languages), sample, dead, request or open."""
    have, every = F.size(F.array_intersect(F.coalesce(held, languages), languages)), F.size(languages)
    full = F.when(have < every, F.concat(F.lit("in hand: "), have.cast("string"), F.lit(" of "), every.cast("string"), F.lit(" languages"))).otherwise("in hand")
    open_ = F.when(status == "deferred", "deferred").when(status == "click_through", "accept terms").otherwise("open")
    return F.when(recorded == "full", full).when(status == "dead", "unavailable").when(recorded == "sample", "sample only").when(status == "request", "on request").otherwise(open_)


def licence_name(licence: Column) -> Column:
    """A licence without its parenthetical."""
    return F.substring_index(licence, " (", 1)


def headline(sets: DataFrame) -> DataFrame:
    """(state, n): how many entries are in each state."""
    return sets.groupBy("state").agg(F.count("*").alias("n"))
