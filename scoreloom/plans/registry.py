"""A small made-up registry of models, datasets, evaluation sets and runs, as rows for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "reg_models": (
        "model string, modality string, status string, wave int, name string",
        [("wav_a", "audio", "ready", 1, "Wav (base)"), ("wav_b", "audio", "later", 2, "Wav (large)"), ("vid_a", "video", "ready", 1, "Vid (one)"), ("img_a", "image", "workable", None, "Img"), ("av_a", "audio_video", "blocked", None, "Joint (av)")],
    ),
    "reg_datasets": (
        "dataset string, modality string, role string, contains array<string>, language string, held boolean",
        [
            ("ds_voice", "audio", "south_asian", ["real", "fake"], "hi", True),
            ("ds_voice_small", "audio", "south_asian", ["fake"], "bn", False),
            ("ds_clips", "video", "south_asian", ["real", "fake"], "hi", True),
            ("ds_joint", "audio_video", "south_asian", ["real", "fake"], "ta", True),
            ("ds_toy", "audio", "pipeline_test", ["real", "fake"], "en", True),
            ("ds_shared", "audio", "reproduction", ["real", "fake"], "en", False),
        ],
    ),
    "reg_corpora": ("corpus string", [("co_read",), ("co_web",), ("ds_shared",)]),
    "reg_edges": ("node string, parent string", [("ds_voice", "co_read"), ("ds_voice_small", "ds_voice"), ("ds_joint", "co_web"), ("ds_clips", "co_web"), ("co_web", "ds_joint"), ("ds_toy", "co_lost")]),
    "reg_sets": ("evalset string, modality string, role string, pairing string, items int", [("es_voice", "audio", "south_asian", "same_corpus", 900), ("es_clips", "video", "south_asian", "cross_corpus", 400), ("es_joint", "audio_video", "south_asian", "same_corpus", 700), ("es_toy", "audio", "pipeline_test", "same_corpus", 4), ("es_old", "audio", "reproduction", "same_corpus", 2000)]),
    "reg_components": (
        "evalset string, position int, dataset string, splits array<string>, label_rule string, modality string, role string",
        [
            ("es_voice", 1, "ds_voice", ["test"], "from_manifest", "audio", "south_asian"),
            ("es_voice", 2, "ds_voice_small", None, "fake", "audio", "south_asian"),
            ("es_clips", 1, "ds_clips", None, "from_manifest", "video", "south_asian"),
            ("es_clips", 2, "ds_voice", None, "from_video", "video", "south_asian"),
            ("es_joint", 1, "ds_joint", None, "from_manifest", "audio_video", "south_asian"),
            ("es_toy", 1, "ds_toy", None, "from_manifest", "audio", "pipeline_test"),
            ("es_toy", 2, "ds_voice_small", None, "real", "audio", "pipeline_test"),
            ("es_old", 1, "ds_shared", ["eval"], "from_manifest", "audio", "reproduction"),
            ("es_old", 2, "ds_gone", None, "from_manifest", "audio", "reproduction"),
        ],
    ),
    "reg_training": (
        "model string, position int, dataset string, level string, split string, items_file string",
        [
            ("wav_a", 1, "ds_shared", "finetune", "train", None),
            ("wav_a", 2, "co_read", "pretrain", None, None),
            ("wav_b", 1, "ds_voice", "finetune", None, "seen.csv"),
            ("wav_b", 2, "ds_shared", "pretrain", None, None),
            ("vid_a", 1, "co_web", "finetune", None, None),
            ("vid_a", 2, "ds_clips", "finetune", None, None),
            ("img_a", 1, "co_none", "pretrain", None, None),
            ("av_a", 1, "ds_joint", "finetune", "train", None),
        ],
    ),
    "reg_runs": (
        "run_id string, model string, evalset string, started string, source_rank int, namespace string, role string, pairing string, verdict string, auc double, unscored_items int, config_hash string, summary string",
        [
            ("r1", "wav_a", "es_voice", "2026-01-02T00:00:00", 0, None, "south_asian", "same_corpus", "source_overlap", 0.91, 3, "a1", '{"model":"wav_a","overall":{"n":900,"auc":0.91},"compute":{"env":{"gpu":"G1"}}}'),
            ("r2", "wav_a", "es_voice", "2026-01-03T00:00:00", 0, None, "south_asian", "same_corpus", "source_overlap", 0.93, 0, "a1", '{"model":"wav_a","overall":{"n":900,"auc":0.93},"compute":{"env":{"gpu":"G1"}}}'),
            ("r3", "wav_a", "es_voice", "2026-01-03T00:00:00", 1, None, "south_asian", "same_corpus", "source_overlap", 0.5, 0, "a1", '{"model":"wav_a"}'),
            ("r4", "wav_a", "es_old", "2026-01-01T00:00:00", 0, None, "reproduction", "same_corpus", "clean", 0.99, 0, "a1", '{"model":"wav_a","overall":{"n":2000,"auc":0.99}}'),
            ("r5", "wav_b", "es_voice", "2026-01-05T00:00:00", 0, None, "south_asian", "same_corpus", "overlap_excluded", 0.41, 7, "b1", '{"model":"wav_b","overall":{"n":900,"auc":0.41},"compute":{}}'),
            ("r6", "wav_b", "es_toy", "2026-01-06T00:00:00", 0, None, "pipeline_test", "same_corpus", "clean", 0.7, 0, "b1", "{}"),
            ("r7", "vid_a", "es_clips", "2026-02-01T00:00:00", 0, "try", "south_asian", "cross_corpus", "contaminated", 0.8, 0, "v1", "{}"),
            ("r8", "vid_a", "es_joint", "2026-02-02T00:00:00", 0, None, "south_asian", "same_corpus", "source_overlap", 0.6, 1, "v1", '{"model":"vid_a","overall":{"n":700,"auc":0.6}}'),
            ("r9", "vid_a", "es_joint", "2026-02-03T00:00:00", 0, None, "south_asian", "same_corpus", "source_overlap", 0.65, 0, "old", '{"model":"vid_a","overall":{"n":700,"auc":0.65}}'),
        ],
    ),
    "reg_hashes": ("model string, config_hash string", [("wav_a", "a1"), ("wav_b", "b1"), ("vid_a", "v1")]),
    "reg_parity": ("model string, passed boolean", [("wav_a", True), ("wav_b", False)]),
    "reg_sessions": ("run_id string, started string, device string, host string, dirty boolean", [("r1", "2026-01-01T01", "G1", "h1", False), ("r1", "2026-01-01T05", "G2", "h2", True), ("r1", "2026-01-01T03", "G1", "h1", False), ("r4", "2026-01-01T00", None, "h1", None), ("r5", "2026-01-05T00", "G1", "h3", False)]),
    "reg_published": ("run_id string", [("r2",), ("r4",)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def sql(name: str) -> str:
    """The rows as a DuckDB query with the same types."""
    schema, rows = TABLES[name]
    kinds = {"string": "varchar", "int": "integer", "double": "double", "boolean": "boolean", "array<string>": "varchar[]"}
    columns = [c.split(" ") for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select {', '.join(f'cast({n} as {kinds[k]}) as {n}' for n, k in columns)} from (values {values}) t({', '.join(n for n, _ in columns)})"
