"""Registry entries from files."""

import json

import pytest

from scoreloom.sources import readers, registry_files


def test_entries_and_problems(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    good = {"id": "m1", "modality": "audio", "trained_on": ["a", "b"], "threshold": 0.5}
    (tmp_path / "m1.yaml").write_text(yaml.safe_dump(good))
    (tmp_path / "m2.yaml").write_text("id: m2\nmodality: video\n")
    schema = "id string, modality string, trained_on array<string>, threshold double"
    got = registry_files.registry(spark, str(tmp_path), schema, ["id", "modality"]).orderBy("id").collect()
    assert [r.asDict() for r in got] == [good, {"id": "m2", "modality": "video", "trained_on": None, "threshold": None}]
    (tmp_path / "m3.yaml").write_text("id: other\nmodalty: video\n")
    (tmp_path / "m4.yaml").write_text("- a list\n")
    (tmp_path / "m5.yaml").write_text("a: [1\n")
    with pytest.raises(ValueError, match="m3: id is other, not the file's name") as e:
        registry_files.registry(spark, str(tmp_path), schema, ["id", "modality"])
    assert all(x in str(e.value) for x in ("m3: missing fields modality", "m3: unknown fields modalty", "m4: unreadable: not a mapping", "m5: unreadable: ParserError"))


def test_json_files_feed_run_records(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"id": f"r{i}", "auc": i / 10}))
    got = registry_files.registry(spark, str(tmp_path), "id string, auc double", ["id", "auc"], "json").orderBy("id").collect()
    assert [(r.id, r.auc) for r in got] == [("r0", 0.0), ("r1", 0.1), ("r2", 0.2)]
    assert {r.id for r in readers.read_records(spark, str(tmp_path), "id string, auc double").collect()} == {"r0", "r1", "r2"}
