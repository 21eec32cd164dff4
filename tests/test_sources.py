from __future__ import annotations

import json

from leafmark.sources import artifacts


def test_artifact_folders(spark, tmp_path):
    root = tmp_path / "artifacts"
    for i, parts in (("a1", {"metadata", "structured", "ocr", "validation"}), ("a2", {"metadata", "structured"}), ("a3", {"metadata"})):
        (root / i).mkdir(parents=True)
        body = {
            "metadata": {"submission_id": i, "original_filename": "x.pdf", "byte_size": 5},
            "structured": {"student_name": "Alva Brook", "grade": 5 if i == "a1" else "K"},
            "ocr": {"text": "hello", "confidence_avg": 0.5},
            "validation": {"needs_review": True, "review_reason_codes": ["SHORT_ESSAY", "MISSING_GRADE"]},
        }
        for p in parts:
            (root / i / f"{p}.json").write_text(json.dumps(body[p]))
    got = {r["submission_id"]: (r["grade"], r["text"], r["review_reason_codes"]) for r in artifacts.import_artifacts(spark, str(root)).collect()}
    assert got == {"a1": ("5", "hello", "SHORT_ESSAY;MISSING_GRADE"), "a2": ("K", None, None)}
    assert artifacts.pick_paths(spark, str(root), ("ocr.json",)).count() == 1
    health = {r["folder"]: r["missing"] for r in artifacts.artifact_health(spark, str(root), ("metadata.json", "ocr.json")).collect()}
    assert health == {"a1": "", "a2": "ocr.json", "a3": "ocr.json"}


def test_json_lines_and_logs(spark, tmp_path):
    artifacts.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    (tmp_path / "worker.log").write_text("2024-01-01 00:00:00 worker job=ab FAILED\n")
    assert artifacts.read_logs(spark, str(tmp_path / "worker.log")).first()["service"] == "worker"
