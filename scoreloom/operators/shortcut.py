"""Shortcut probes: trivial features of clips, their single AUCs, and an out-of-fold logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import roc
from ..functions.scalar import hash_rank
from .settle import settle

#: Samples of a frame and of a step, silence in dB under the loudest frame, share of the power below rolloff.
FRAME, HOP, SILENCE_DB, ROLLOFF = 400, 160, 40.0, 0.85
FEATURES = ("duration_s", "rms_db", "silence_ratio", "spectral_rolloff_hz", "spectral_bandwidth_hz", "original_sample_rate")


#: Samples that are framed at once: a batch of clips is worked off in groups of about this size.
GROUP_SAMPLES = 1 << 20


def _spectra(samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energy of each windowed frame, and its power at each frequency."""
    framed = samples[starts[:, None] + np.arange(FRAME)] * np.hanning(FRAME)
    spectrum = np.fft.rfft(framed, axis=1)
    return np.einsum("ij,ij->i", framed, framed), spectrum.real**2 + spectrum.imag**2


def group_features(waves: list[np.ndarray], rate: int) -> np.ndarray:
    """A row for each clip: the five measured features. All clips' frames go through one transform; a clip's values are sums
    over its own run of frames."""
    lengths = np.array([len(w) for w in waves])
    room = np.maximum(lengths, FRAME)  # short clips are filled up with silence to one frame
    begin = np.concatenate([[0], np.cumsum(room)])
    samples = np.zeros(begin[-1])
    for at, wave in zip(begin, waves, strict=False):
        samples[at : at + len(wave)] = wave
    per_clip = (room - FRAME) // HOP + 1
    first = np.cumsum(per_clip) - per_clip
    owner = np.repeat(np.arange(len(waves)), per_clip)
    energy, power = _spectra(samples, begin[owner] + HOP * (np.arange(len(owner)) - first[owner]))

    squares = np.add.reduceat(samples**2, begin[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        rms_db = np.maximum(np.nan_to_num(10 * np.log10(squares / lengths), nan=-120.0), -120.0)
    # a frame is silent by its energy's ratio to that of the clip's loudest, with the floor added to both
    floored = energy + 1e-12
    heard = floored > np.maximum.reduceat(floored, first)[owner] * 10 ** (-SILENCE_DB / 10)
    silence = 1 - np.add.reduceat(heard.astype(float), first) / per_clip

    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    total, moment, second = power.sum(axis=1), power @ hz, power @ hz**2
    used = heard & (total > 0)
    safe = np.where(used, total, 1.0)
    spread = np.sqrt(np.maximum(second / safe - (moment / safe) ** 2, 0.0))
    below = (np.cumsum(power, axis=1) < ROLLOFF * total[:, None]).sum(axis=1)
    edge = hz[np.minimum(below, len(hz) - 1)]
    n_used = np.maximum(np.add.reduceat(used.astype(float), first), 1)
    rolloff, width = (np.add.reduceat(np.where(used, x, 0.0), first) / n_used for x in (edge, spread))
    return np.stack([lengths / rate, rms_db, silence, rolloff, width], axis=1)


def clip_features(wave: np.ndarray, rate: int, original_rate: float) -> tuple[float, ...]:
    """One clip's features."""
    return (*group_features([np.asarray(wave, float)], rate)[0].tolist(), float(original_rate))


def features(clips: DataFrame, rate: int, key: str = "item_id") -> DataFrame:
    """``clips(key, wave array, original_rate)`` to (key, status, features): a clip that can't be read is a row with a status."""

    def read(wave: object) -> tuple[np.ndarray | None, str]:
        try:
            return np.asarray(wave, float).reshape(-1), "ok"
        except (TypeError, ValueError) as e:
            return None, f"error: {type(e).__name__}"

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            waves, statuses = zip(*map(read, b["wave"]), strict=True)
            values = np.full((len(b), len(FEATURES)), np.nan)
            group: list[int] = []
            held = 0
            for i, wave in enumerate(waves):
                if wave is not None:
                    group.append(i)
                    held += max(len(wave), FRAME)
                if group and (held >= GROUP_SAMPLES or i + 1 == len(waves)):
                    values[group, :-1] = group_features([waves[k] for k in group], rate)
                    values[group, -1] = b["original_rate"].to_numpy(float)[group]
                    group, held = [], 0
            out = pd.DataFrame(values, columns=list(FEATURES)).astype(object).where(~np.isnan(values), None)
            out.insert(0, "status", statuses)
            out.insert(0, key, b[key].to_numpy())
            yield out

    kind = clips.schema[key].dataType.simpleString()
    return clips.select(key, "wave", "original_rate").mapInPandas(work, f"{key} {kind}, status string, " + ", ".join(f"{f} double" for f in FEATURES))


def feature_aucs(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(feature, auc): how far each feature alone separates the classes, max(a, 1 - a); a half for a constant one."""
    long = df.select(roc.binary(label).alias("y"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["y"], columns, "feature", "s").where("s is not null and y is not null")
    return roc.areas(long, ["feature"]).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def class_means(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(*(F.round(F.avg(c), 4).alias(c) for c in columns))


def probe(df: DataFrame, columns: list[str], folds: int = 5, seed: int = 0, key: str = "item_id", label: str = "label") -> DataFrame:
    """(key, y, s): each row's probability by a logistic regression on standardised features that was fitted on the other
    folds. A fold is the hash rank within the class modulo ``folds``."""
    rows = df.select(key, roc.binary(label).cast("double").alias("y"), hash_rank(seed, key).alias("hash"), *(F.col(c).cast("double").alias(c) for c in columns))
    # ranks within a class are counted in parts of the hash and over them
    rows = settle(rows.dropna().withColumn("part", F.substring("hash", 1, 3)))
    counts = rows.groupBy("y", "part").agg(F.count("*").alias("n"))
    starts = counts.select("y", "part", (F.sum("n").over(Window.partitionBy("y").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("y", "part").orderBy("hash", key)) - 1
    rows = rows.withColumn("local", local).join(starts, ["y", "part"])
    rows = settle(rows.select(key, "y", ((F.col("before") + F.col("local")) % folds).alias("fold"), *columns))
    out = None
    for f in range(folds):
        train = rows.where(F.col("fold") != f)
        stats = train.agg(F.count("*").alias("n"), *(x.alias(n) for c in columns for x, n in ((F.avg(c), f"m_{c}"), (F.stddev_pop(c), f"d_{c}")))).first()
        scale = {c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"d_{c}"] or 1.0) for c in columns}
        put = VectorAssembler(inputCols=columns, outputCol="x")
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / max(stats["n"], 1), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-9)
        fitted = model.fit(put.transform(train.withColumns(scale)))
        part = fitted.transform(put.transform(rows.where(F.col("fold") == f).withColumns(scale))).select(key, "y", vector_to_array("probability")[1].alias("s"))
        out = part if out is None else out.unionByName(part)
    return out
