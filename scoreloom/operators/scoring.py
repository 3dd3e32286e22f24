"""Unit scores to item scores, scored items, resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways to reduce an item's unit scores.
AGGREGATIONS: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.percentile(c, 0.5),
}


def item_scores(units: DataFrame, how: str = "mean", key: str = "item_id", score: str = "unit_score") -> DataFrame:
    """(key, score, n_windows). Scores are rounded to 9 digits, so the order of summation can't split ties."""
    return units.groupBy(key).agg(F.round(AGGREGATIONS[how](score), 9).alias("score"), F.count("*").alias("n_windows"))


def score_parts(units: DataFrame, min_units: int = 2, key: str = "item_id") -> DataFrame:
    """Score rows with a status: an item of fewer than ``min_units`` units failed, and keeps only its load time."""
    g = units.groupBy(key).agg(F.count("*").alias("n"), F.avg("unit_score").alias("s"), F.sum("load_s").alias("load"), F.sum("infer_s").alias("infer"))
    ok = F.col("n") >= min_units
    return g.select(
        key,
        F.when(ok, F.round("s", 9)).alias("score"),
        F.when(ok, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_windows"),
        F.when(ok, "ok").otherwise("too_short").alias("status"),
        F.round("load", 9).alias("load_s"),
        F.when(ok, F.round("infer", 9)).alias("infer_s"),
    )


def scored_items(items: DataFrame, scores: DataFrame, key: str = "item_id") -> DataFrame:
    """Items with their scores; items without one are left out (count them with ``unscored``)."""
    return items.join(scores, key, "inner")


def unscored(items: DataFrame, scores: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that no score row has: what is left to do when a run resumes."""
    return items.join(scores.select(key), key, "left_anti")


def cached(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    return items.join(done.select(key), key, "left_semi")


def failures_by_status(scores: DataFrame) -> DataFrame:
    return scores.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


def score_checks(scores: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """One row: rows with a status that isn't known, and scores that are missing or out of [0, 1]."""
    ok = F.col("status") == "ok"
    return scores.agg(
        F.count_if(~F.col("status").isin(*allowed)).alias("unknown_status"),
        F.count_if(ok & F.coalesce(~F.col("score").between(0, 1), F.lit(True))).alias("bad_score"),
        F.count_if(~ok & F.col("score").isNotNull()).alias("failed_with_score"),
    )


class Scorer:
    """A scorer plug-in: ``load`` once in each Python worker, then ``score`` a batch of inputs to P(fake)."""

    def load(self) -> None: ...

    def score(self, inputs: pd.Series) -> pd.Series:
        raise NotImplementedError


class Loader:
    """A loader plug-in: turns rows into a scorer's inputs. ``columns`` are the item columns it reads. An input that can't be
    made is None, with the status that says why."""

    columns: tuple[str, ...] = ()

    def open(self) -> None: ...

    def load(self, rows: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
        """Inputs, and statuses, ok among them."""
        raise NotImplementedError


class ColumnLoader(Loader):
    """The inputs as they stand in a column; null is unreadable."""

    def __init__(self, column: str) -> None:
        self.columns = (column,)

    def load(self, rows: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
        inputs = rows[self.columns[0]]
        return inputs, inputs.notna().map({True: "ok", False: "unreadable"})


def run_scorer(items: DataFrame, scorer: Scorer, inputs: str | Loader, key: str = "item_id") -> DataFrame:
    """(key, score, status) by a scorer, and a loader of its inputs (or the column that has them), that stay loaded for a whole
    partition. An item whose inputs can't be made has no score and its loader's status; a loader that fails as a whole, or
    a scorer that does, is the job's failure."""
    loader = ColumnLoader(inputs) if isinstance(inputs, str) else inputs

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.load()
        loader.open()
        for b in batches:
            made, status = loader.load(b[list(loader.columns)])
            out = pd.DataFrame({key: b[key], "score": pd.Series(None, index=b.index, dtype="float64"), "status": status})
            there = status == "ok"
            if there.any():
                out.loc[there, "score"] = scorer.score(made[there]).to_numpy()
            yield out

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, *loader.columns).mapInPandas(work, f"{key} {kind}, score double, status string")


def dummy_score(values: Column) -> Column:
    """The scorer used in tests, as an expression: the sigmoid of an array's mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return 1 / (1 + F.exp(-mean))
