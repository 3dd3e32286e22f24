"""Energy of sessions as their samples arrive: a state for each session carries the trapezoid from batch to batch.

Samples that the watermark may still overtake wait in the state; those behind it are integrated and dropped, but for the
last one, which the next trapezoid begins at. Each batch gives a session's totals over all that has arrived, waiting samples
included, so any split into batches ends with what ``telemetry.energy`` gives of all samples at once, if none comes later
than the watermark allows (Spark drops those). A session that has been idle for long enough by event time gives its totals
a last time, marked ``ended``, and its state goes.

Samples need a time and watts; rows without either don't count. Ties of time are in the order of event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "last_us long, last_watts double, samples long, total double, most double, joules double, waiting_us array<long>, waiting_id array<long>, waiting_watts array<double>"


def _joules(us: np.ndarray, watts: np.ndarray) -> float:
    """The area under the samples, which are in order."""
    return float((np.diff(us) / 1e6 * (watts[1:] + watts[:-1]) / 2).sum())


def running_energy(samples: DataFrame, by: str = "session_id", lateness: str = "1 hour", idle_s: int = 6 * 3600) -> DataFrame:
    """Stream ``samples(by, ts, event_id, watts)`` to updates (by, samples, power_mean_w, power_max_w, energy_wh, ended)."""
    rows = samples.where(F.col(by).isNotNull() & F.col("ts").isNotNull() & F.col("watts").isNotNull())
    rows = rows.select(by, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("watts").cast("double").alias("watts"))
    rows = rows.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_us, last_watts, n, total, most, joules, *waiting = state.get if state.exists else (None, 0.0, 0, 0.0, float("-inf"), 0.0, [], [], [])
        us, ids, watts = (np.array(w, t) for w, t in zip(waiting, (np.int64, np.int64, float), strict=True))
        ended = state.hasTimedOut
        for b in () if ended else batches:
            us, ids, watts = (np.concatenate([a, b[c].to_numpy()]) for a, c in ((us, "us"), (ids, "event_id"), (watts, "watts")))
            n, total, most = n + len(b), total + float(b["watts"].sum()), max(most, float(b["watts"].max()))
        order = np.lexsort((ids, us))
        us, ids, watts = us[order], ids[order], watts[order]
        line = (us, watts) if last_us is None else (np.concatenate([[last_us], us]), np.concatenate([[last_watts], watts]))
        yield pd.DataFrame({by: [key[0]], "samples": [n], "power_mean_w": [total / n], "power_max_w": [most], "energy_wh": [(joules + _joules(*line)) / 3600], "ended": [ended]})
        if ended:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        newest = int(us[-1]) if len(us) else last_us
        done = int(np.searchsorted(us, mark * 1000, side="left"))  # nothing before the watermark comes any more
        if done:
            head = (us[:done], watts[:done]) if last_us is None else (np.concatenate([[last_us], us[:done]]), np.concatenate([[last_watts], watts[:done]]))
            joules, last_us, last_watts = joules + _joules(*head), int(us[done - 1]), float(watts[done - 1])
        state.update((last_us, last_watts, n, total, most, joules, us[done:].tolist(), ids[done:].tolist(), watts[done:].tolist()))
        state.setTimeoutTimestamp(max(newest // 1000 + idle_s * 1000, mark + 1))

    kind = samples.schema[by].dataType.simpleString()
    out = f"`{by}` {kind}, samples long, power_mean_w double, power_max_w double, energy_wh double, ended boolean"
    return rows.groupBy(by).applyInPandasWithState(work, out, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
