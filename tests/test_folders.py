"""Artifact folders as a data source: names, damaged and half-written folders, repeated and failed writes."""

from __future__ import annotations

import json
import os
import tarfile

import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from leafmark.sources import artifacts, folders, queries
from leafmark.sources.folders import SCHEMA, ArtifactFolders, Bundle, FolderWriter, PackWriter


def files_of(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and "_commits" not in p.parts}


def test_files_get_their_names_and_come_back(spark, tmp_path):
    rows = [(f"f{i}", name, f"{name} of {i} é\n") for i in range(20) for name in ("a.json", "deep/b.txt")]
    frame = spark.createDataFrame(rows, "folder string, name string, body string")
    for _ in range(2):  # writing again changes nothing
        artifacts.write_folders(frame, str(tmp_path))
        assert files_of(tmp_path) == {f"{f}/{n}": b for f, n, b in rows}
    read = spark.read.format("artifact_folders").option("names", "a.json").option("bundle", 3).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 7
    got = {r["folder"]: [tuple(x) for x in r["files"]] for r in read.collect()}
    assert got["f3"] == [("a.json", "f3/a.json", len("a.json of 3 é\n".encode()), "a.json of 3 é\n"), ("deep/b.txt", "f3/deep/b.txt", len("deep/b.txt of 3 é\n".encode()), None)] and len(got) == 20
    commits = [json.loads(p.read_text()) for p in tmp_path.glob("_commits/*/_SUCCESS")]
    assert len(commits) == 2 and sum(len(json.loads((p.parent / n).read_text())) for p in tmp_path.glob("_commits/*/_SUCCESS") for n in json.loads(p.read_text())) == 2 * len(rows)


def test_a_failed_write_takes_its_files_back(tmp_path):
    writer = FolderWriter(str(tmp_path), False)
    done = writer.write(iter([{"folder": "x", "name": "a.txt", "body": "1"}, {"folder": "x", "name": "b.txt", "body": None}]))

    def breaks():
        yield {"folder": "y", "name": "a.txt", "body": "1"}
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    assert set(files_of(tmp_path)) == {"x/a.txt", "x/b.txt", "y/a.txt"}
    writer.abort([done, None])
    assert set(files_of(tmp_path)) == {"y/a.txt"} and not list(tmp_path.glob("_commits/*/_SUCCESS"))
    assert ArtifactFolders({"path": str(tmp_path)}).schema() == SCHEMA


def test_nothing_there_and_half_written_files(spark, tmp_path):
    assert artifacts.folders(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / ".metadata.json.123").write_text("{")
    (tmp_path / "_commits").mkdir()
    (tmp_path / "loose.txt").write_text("x")
    assert [tuple(r) for r in artifacts.folders(spark, str(tmp_path), ("metadata.json",)).collect()] == [("f", [])]
    reader = ArtifactFolders({"path": str(tmp_path)}).reader(None)
    assert reader.partitions() == [Bundle(("f",))] and list(reader.read(Bundle(("f",)))) == [("f", [])]


def test_records_of_damaged_folders(spark, tmp_path):
    good = {"metadata.json": '{"submission_id": "s1", "extra": [1]}', "structured.json": '{"grade": 5, "_private": {"k": 1}, "word_count": 7}'}
    cases = {
        "good": good,
        "no id": good | {"metadata.json": '{"submission_id": ""}', "validation.json": '{"review_reason_codes": ["B", "A"]}'},
        "no metadata": {"structured.json": "{}"},
        "no fields": {"metadata.json": "{}"},
        "broken metadata": good | {"metadata.json": '{"submission_id": '},
        "broken metadata alone": {"metadata.json": "x"},
        "broken recognition": good | {"ocr.json": ""},
        "nothing": {"notes.txt": "n"},
    }
    rows = [(folder, name, body) for folder, files in cases.items() for name, body in files.items()]
    artifacts.write_folders(spark.createDataFrame(rows, "folder string, name string, body string"), str(tmp_path))
    got = {r["folder"]: r for r in artifacts.artifact_records(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "good": "imported", "no id": "imported", "no metadata": "skipped", "no fields": "skipped", "broken metadata": "error", "broken metadata alone": "error", "broken recognition": "error", "nothing": "skipped",
    }
    assert (got["good"]["submission_id"], got["good"]["grade"], got["good"]["word_count"], got["good"]["filename"]) == ("s1", "5", 7, "unknown")
    assert (got["no id"]["submission_id"], got["no id"]["review_reason_codes"]) == ("no id", "B;A")
    reference = spark.range(0).select(F.lit("x").alias("school_key"))
    codes = {r["folder"]: (r["review_reason_codes"], r["needs_review"]) for r in artifacts.reviewed_import(spark, str(tmp_path), reference).collect()}
    assert codes["no id"] == ("B;A", True) and "MISSING_STUDENT_NAME" in codes["good"][0] and len(codes) == 2
    health = {r["folder"]: r for r in artifacts.artifact_health(spark, str(tmp_path)).collect()}
    assert health["broken recognition"]["corrupted"] == "ocr.json" and health["broken recognition"]["empty"] == "ocr.json"
    assert health["nothing"]["missing"].startswith("original.pdf/original.jpg,metadata.json") and health["nothing"]["odd_size"] == "small"


def read_back(spark, root, names=""):
    rows = spark.read.format("artifact_folders").option("names", names).load(str(root)).collect()
    assert len({r["folder"] for r in rows}) == len(rows)
    return {r["folder"]: [tuple(f) for f in r["files"]] for r in rows}


def test_packed_folders_read_like_loose_ones(spark, tmp_path):
    long = "a/" + "n" * 150 + "é.txt"
    rows = [(f"f{i}", name, body) for i in range(50) for name, body in (("a.json", f"{{{i}}} é"), ("deep/a.json", "x" * i * 1000), (long, None), (".hidden", "h"), ("b.txt", f"{i}\n"))]
    frame = spark.createDataFrame(rows, "folder string, name string, body string")
    artifacts.write_folders(frame, str(tmp_path / "loose"))
    artifacts.write_folders(frame, str(tmp_path / "packed"), packed=True)
    got = read_back(spark, tmp_path / "packed", "a.json")
    assert got == read_back(spark, tmp_path / "loose", "a.json") and len(got) == 50 and {len(files) for files in got.values()} == {4}
    assert read_back(spark, tmp_path / "packed") == read_back(spark, tmp_path / "loose")
    # Unpacked by other means, archives give the folders and files of these names.
    for pack in (tmp_path / "packed" / "_packs").glob("*.tar.zst"):
        with pa.input_stream(str(pack), compression="zstd") as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            tar.extractall(tmp_path / "again", filter="data")
    assert files_of(tmp_path / "again") == files_of(tmp_path / "loose")


def test_archives_hold_whole_folders_and_only_committed_ones_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "PACK_FOLDERS", 3)
    monkeypatch.setattr(folders, "PACK_BYTES", 1000)
    rows = [{"folder": f"f{i}", "name": name, "body": "x" * (2000 if i == 1 else 1)} for i in range(8) for name in ("a", "b", "a")]
    one, lost = PackWriter(str(tmp_path), False), PackWriter(str(tmp_path), False)
    first, again, none = one.write(iter(rows)), one.write(iter(rows)), one.write(iter([]))
    assert len(first.names) == 3 and none.names == ()  # f0 and f1, f2 to f4, f5 to f7
    reader = ArtifactFolders({"path": str(tmp_path), "names": "a"}).reader(None)
    assert reader.partitions() == [Bundle(())]
    other = lost.write(iter(rows[:3]))
    one.commit([first, none, None])
    found = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted(f for f, _ in found) == [f"f{i}" for i in range(8)] and len(reader.partitions()) == 3 and again.names
    assert dict(found)["f1"] == [("a", "f1/a", 2000, "x" * 2000), ("b", "f1/b", 2000, None)]
    # Of two jobs the later one fails and leaves nothing; a packed root is written once, and one that holds folders is not packed.
    with pytest.raises(FileExistsError):
        lost.commit([other])
    lost.abort([other])
    lost.abort([None])
    assert {p.name for p in tmp_path.iterdir()} == {"_packs"}
    for writer in (FolderWriter, PackWriter):
        with pytest.raises(FileExistsError):
            writer(str(tmp_path), False)
    (tmp_path / "loose" / "f").mkdir(parents=True)
    with pytest.raises(FileExistsError):
        PackWriter(str(tmp_path / "loose"), False)
    PackWriter(str(tmp_path), True).commit([])
    assert reader.partitions() == [Bundle(())] and not list(reader.read(Bundle(())))


def test_a_damaged_archive_fails_the_read(spark, tmp_path):
    artifacts.write_folders(spark.createDataFrame([("f", "a.json", os.urandom(50_000).hex())], "folder string, name string, body string"), str(tmp_path), packed=True)
    (pack,) = (tmp_path / "_packs").glob("*.tar.zst")
    pack.write_bytes(pack.read_bytes()[:20_000])
    with pytest.raises(Exception, match=r"tarfile|Truncated|unexpected end|zstd|ZSTD"):
        artifacts.folders(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", ["import_artifacts", "artifact_health", "artifact_health_summary"])
def test_folders_of_queries_take_less_disk_than_their_contents(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "shared_dir", lambda s: str(tmp_path / "root"))
    assert queries.QUERIES[name](spark, SF).count() > 0
    taken = sum(p.lstat().st_blocks * 512 for p in tmp_path.rglob("*"))
    got = read_back(spark, tmp_path / "root")
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert taken < sum(size for files in got.values() for _, _, size, _ in files)
