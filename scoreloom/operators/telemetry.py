"""Run telemetry: timings, session roll-ups, sampled energy, paired scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def timing(rows: DataFrame, seconds: str, by: list[str], digits: int = 2) -> DataFrame:
    """(by, mean, p50, p95) in milliseconds, exact percentiles with linear interpolation, null without values."""
    ms = F.col(seconds) * 1000
    means = rows.groupBy(*by).agg(F.bround(F.avg(ms), digits).alias("mean"))
    found = exact_quantiles(rows, by, ms, {"p50": 0.5, "p95": 0.95})
    return _beside(means, found, by).select(*by, "mean", *(F.bround(c, digits).alias(c) for c in ("p50", "p95")))


def _beside(groups: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` with the columns of ``found``, null keys being equal."""
    found = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & groups[c].eqNullSafe(found[f"_{c}"])
    return groups.join(found, same, "left").drop(*(f"_{c}" for c in by))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def energy(samples: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, samples, power_mean_w, power_max_w, energy_wh): the trapezoid area under the sampled power."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    seconds = _micros(F.col("ts")) / 1e6
    rows = samples.withColumn("t", seconds)
    rows = rows.withColumn("area", (F.col("t") - F.lag("t").over(w)) * (F.col("watts") + F.lag("watts").over(w)) / 2)
    return rows.groupBy(by).agg(F.count("*").alias("samples"), F.avg("watts").alias("power_mean_w"), F.max("watts").alias("power_max_w"), (F.coalesce(F.sum("area"), F.lit(0.0)) / 3600).alias("energy_wh"))


def _ranked(samples: DataFrame, value: str, q: float, by: str) -> DataFrame:
    """``samples`` with the two values of its id next to quantile ``q``, each on one row (low, high), and how far it is
    from the first to the second (part)."""
    own = Window.partitionBy(by)
    rank = (F.col("_n") - 1) * q
    rows = samples.withColumns({"_n": F.count(value).over(own), "_at": F.row_number().over(own.orderBy(F.col(value).asc_nulls_last())) - 1})
    rows = rows.withColumns({"low": F.when(F.col("_at") == F.floor(rank), F.col(value)), "high": F.when(F.col("_at") == F.ceil(rank), F.col(value)), "part": rank - F.floor(rank)})
    return rows.drop("_n", "_at")


def _between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, the first product unrounded until it is added, as a fused multiply-add has it: the
    product's and the sum's errors are kept (Dekker, Knuth), so that halves fall as they do in SQL."""

    def split(x: Column) -> tuple[Column, Column]:
        head = x * 134_217_729.0 - (x * 134_217_729.0 - x)
        return head, x - head

    rest = F.lit(1.0) - part
    (a, b), (c, d) = split(low), split(rest)
    p, other = low * rest, high * part
    lost = ((a * c - p) + a * d + b * c) + b * d
    s = p + other
    return s + (((p - (s - (s - p))) + (other - (s - p))) + lost)


def sampler_stats(samples: DataFrame, by: str = "session_id", metered: Column | None = None) -> DataFrame:
    """A row for each id: use, memory, power and temperature of its samples (ts, event_id, util, used_gb, watts, temp,
    counter_mj). Energy is what the counter gained, in millijoules, for ids that are ``metered`` (those whose counter was read
    at both ends, if not given), else the trapezoid area under the power. Samples without a time come last and are no end."""
    w = Window.partitionBy(by).orderBy(F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    rows = _ranked(samples, "util", 0.95, by).withColumn("t", _micros(F.col("ts")) / 1e6)
    rows = rows.withColumn("area", (F.col("t") - F.lag("t").over(w)) * (F.col("watts") + F.lag("watts").over(w)) / 2)
    at = F.when(F.col("ts").isNotNull(), F.struct("ts", "event_id"))
    gained = (F.max_by("counter_mj", at) - F.min_by("counter_mj", at)) / 3.6e6
    area = F.coalesce(F.sum("area"), F.lit(0.0)) / 3600
    metered = gained.isNotNull() if metered is None else metered
    rounded = {
        "gpu_util_mean": (F.avg("util"), 1),
        "gpu_util_p95": (_between(F.max("low"), F.max("high"), F.max("part")), 1),
        "gpu_mem_used_max_gb": (F.max("used_gb"), 3),
        "power_mean_w": (F.avg("watts"), 1),
        "power_max_w": (F.max("watts"), 1),
        "temp_max_c": (F.max("temp"), 1),
        "energy_wh": (F.when(metered, gained).otherwise(area), 3),
    }
    source = F.when(metered, "counter").otherwise("integrated")
    # halves to even after scaling, as SQL's round_even does; bround would go by the last bit of what scaling makes a half
    columns = ((F.rint(c.cast("double") * 10.0**digits) / 10.0**digits).alias(name) for name, (c, digits) in rounded.items())
    return rows.groupBy(by).agg(F.count("*").alias("samples"), *columns, source.alias("energy_source"))


def sessions(samples: DataFrame, by: str = "session_id") -> DataFrame:
    """A session row for each id: items, wall time, completion and phase times, from its samples."""
    g = samples.groupBy(by)
    base = g.agg(
        F.count("*").alias("items"),
        ((_micros(F.max("ts")) - _micros(F.min("ts"))) / 1e6).alias("wall_s"),
        (F.count_if(F.col("phase") == "purchase") > 0).alias("completed"),
        F.max("watts").alias("peak"),
        F.avg("watts").alias("mean_w"),
    )
    phases = samples.groupBy(by, "phase").agg(F.sum("watts").alias("s")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("phase", "s"))).alias("phases_s"))
    return base.join(phases, by)


def roll_up(rows: DataFrame, score_phase: str) -> DataFrame:
    """One row over all sessions: sums, completed sessions, rate over the scoring phase (null where that took no time), the
    mean weighted by samples, the peak, and energy for 1,000 items (null without energy or items)."""
    score = F.coalesce(F.try_element_at("phases_s", F.lit(score_phase)), F.lit(0.0))
    got = rows.agg(
        F.count("*").alias("sessions"),
        F.count_if("completed").alias("sessions_completed"),
        F.sum("wall_s").alias("wall_s"),
        F.sum("items").alias("items"),
        F.sum(score).alias("score_s"),
        F.sum(F.col("mean_w") * F.col("items")).alias("weighted"),
        F.max("peak").alias("peak"),
        F.sum("energy_wh").alias("energy_wh"),
    )
    rate = F.try_divide(F.col("items").cast("double"), F.nullif(F.col("score_s"), F.lit(0.0)))
    each = F.when((F.col("energy_wh") != 0) & (F.col("items") != 0), F.col("energy_wh") / F.col("items") * 1000)
    return got.select("sessions", "sessions_completed", "wall_s", "items", "score_s", rate.alias("items_per_s"), F.try_divide("weighted", "items").alias("mean_w"), "peak", "energy_wh", each.alias("energy_wh_per_1k_items"))


def phase_totals(rows: DataFrame) -> DataFrame:
    """(phase, seconds): the sessions' phase maps added up by key."""
    return rows.select(F.explode("phases_s").alias("phase", "s")).groupBy("phase").agg(F.sum("s").alias("seconds"))


def parity(pairs: DataFrame, tolerance: float, a: str = "adapter", b: str = "reference") -> DataFrame:
    """One row: pairs, largest and mean difference, and whether there are any and all agree."""
    d = F.abs(F.col(a) - F.col(b))
    got = pairs.agg(F.count("*").alias("n"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))
    return got.withColumn("passed", F.coalesce((F.col("n") > 0) & (F.col("max_diff") <= tolerance), F.lit(False)))


def profile(rows: DataFrame, by: str, seconds: str, units: str) -> DataFrame:
    """(by, median_ms, median_ms_per_unit, mean_units)."""
    ms = F.col(seconds) * 1000
    out = _beside(rows.groupBy(by).agg(F.avg(units).alias("mean_units")), exact_quantiles(rows, [by], ms, {"median_ms": 0.5}), [by])
    out = _beside(out, exact_quantiles(rows, [by], F.try_divide(ms, F.col(units)), {"median_ms_per_unit": 0.5}), [by])
    return out.select(by, "median_ms", "median_ms_per_unit", "mean_units")


def estimate_seconds(modality: Column, items: Column, windows: Column, ms_per_unit: Column, ms_per_item: Column) -> Column:
    """Model-only time for a set: an audio model's by window (null until a run has counted them), another's by item."""
    return F.when(modality == "audio", windows * ms_per_unit / 1000).otherwise(items * ms_per_item / 1000)
