"""Versioned tables: which files updates rewrite and reads open, what readers of a version see, failed and competing commits."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from leafmark.sources import stored
from leafmark.sources.stored import Conflict, StoredTable

ROWS = 2000


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(ROWS).select(
        F.sha2(F.col("id").cast("string"), 256).alias("key"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("at"), F.col("id").alias("value"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("group")
    )
    made = StoredTable(spark, str(tmp_path / "t"), ("key",), ("at",), 100)
    assert made.create(rows) == 1
    return made


def content(frame):
    return {r["key"]: r["value"] for r in frame.collect()}


def names(files):
    return {r["file"] for r in files.select("file").collect()}


def key_of(i):
    import hashlib

    return hashlib.sha256(str(i).encode()).hexdigest()


def test_reads_open_few_files(spark, table):
    every = names(table.files())
    assert 18 <= len(every) <= 24 and table.files().agg(F.sum("rows")).first()[0] == ROWS and len(table.read().inputFiles()) == len(every)
    low, high = 1_700_000_000 + 60 * 500, 1_700_000_000 + 60 * 620
    some = table.between("at", F.timestamp_seconds(F.lit(low)), F.timestamp_seconds(F.lit(high)))
    assert sorted(content(some).values()) == list(range(500, 620)) and len(some.inputFiles()) <= 3
    # Keys are hashes and lie in no order: bounds don't help, bitmaps do.
    found = table.lookup([(key_of(7),), (key_of(1999),), ("nobody",)])
    assert content(found) == {key_of(7): 7, key_of(1999): 1999} and len(found.inputFiles()) <= 4
    assert table.lookup([("nobody",)]).count() == 0 and table.lookup([]).count() == 0
    data = next(os.path.join(folder, f) for folder, _, files in os.walk(f"{table.root}/data") for f in files if f.endswith(".parquet"))
    import pyarrow.parquet as pq

    assert pq.ParquetFile(data).metadata.num_rows <= 100


def test_only_touched_files_are_rewritten(spark, table):
    before = names(table.files())
    delta = spark.createDataFrame([(key_of(5), dt.datetime(2023, 11, 14, 22, 20), -5, 1), (key_of(6), dt.datetime(2023, 11, 14, 22, 20), -6, None), ("new", dt.datetime(2030, 1, 1), -7, 1)], "key string, at timestamp, value long, group long")
    assert table.upsert(delta) == 2
    after = names(table.files())
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    want = {key_of(i): i for i in range(ROWS)} | {key_of(5): -5, key_of(6): -6, "new": -7}
    assert content(table.read()) == want
    # Readers of the first version see what they saw; so does a frame that was made before the update.
    assert content(table.read(1)) == {key_of(i): i for i in range(ROWS)}
    assert table.delete(spark.createDataFrame([(key_of(1000),), ("never there",)], "key string")) == 3
    assert content(table.read()) == {k: v for k, v in want.items() if k != key_of(1000)} and len(names(table.files()) & after) == len(after) - 1
    # Nothing of it is there: no file is rewritten.
    assert table.delete(spark.createDataFrame([("never there",)], "key string")) == 4 and names(table.files(4)) == names(table.files(3))


def test_a_group_that_grows(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 60).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("v"))
    table = StoredTable(spark, str(tmp_path / "g"), ("a", "b"), ("a", "b"), 50)
    table.create(rows)
    new = spark.range(130).select(F.lit(7).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), (-F.col("id")).alias("v"))
    before = names(table.files())
    table.update(new, lambda own: own.join(new.select("a", "b").distinct(), ["a", "b"], "left_anti").unionByName(new))
    assert len(before - names(table.files())) <= 2
    got = table.read().groupBy((F.col("a") == 7).alias("it")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
    assert {r["it"]: (r["n"], r["s"]) for r in got} == {True: (130, -sum(range(130))), False: (590, sum(v for v in range(600) if v % 60 != 7))}


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_files_take_no_more_room_than_their_rows(spark, tmp_path):
    rows = spark.range(ROWS).select((F.col("id") * 7919 % 100_003).alias("a"), F.col("id").alias("b"))
    table = StoredTable(spark, str(tmp_path / "s"), ("a", "b"), ("a", "b"), 100)
    table.create(rows)
    assert 18 <= table.files().count() <= 24 and size_of(tmp_path / "s" / "data") < 24 * 20_000
    # An update leaves its new files and nothing else that it has written.
    table.update(rows.where("b % 50 = 1"), lambda own: own.where("b % 50 <> 1"))
    listed = names(table.files(1)) | names(table.files())
    found = {os.path.relpath(os.path.join(at, f), tmp_path / "s") for at, _, files in os.walk(tmp_path / "s" / "data") for f in files if f.endswith(".parquet")}
    assert found == listed and table.read().count() == ROWS - ROWS // 50


def test_large_tables_have_larger_files_and_as_good_bitmaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "MOST_FILES", 4)
    monkeypatch.setattr(stored, "FILE_ROWS", 1000)
    rows = spark.range(12_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("at"))
    table = StoredTable(spark, str(tmp_path / "l"), ("key",), ("at",), 500)
    table.create(rows)
    files = table.files().collect()
    assert len(files) <= 8 and max(r["rows"] for r in files) == 3000 and {len(r["keys"]) for r in files} == {3 * stored.BITS // 8}
    assert sum(bin(b).count("1") for r in files for b in r["keys"]) > 10_500
    for i in (0, 5999, 11_999):
        found = table.lookup([(key_of(i),)])
        assert [r["at"] for r in found.collect()] == [i] and len(found.inputFiles()) <= 2
    assert table.upsert(spark.createDataFrame([(key_of(3), -3), ("new", 12_001)], "key string, at long")) == 2
    got = {r["key"]: r["at"] for r in table.read().collect()}
    assert got == {key_of(i): i for i in range(12_000)} | {key_of(3): -3, "new": 12_001} and len(names(table.files()) & {r["file"] for r in files}) == len(files) - 1
    assert [r["at"] for r in table.lookup([("new",), (key_of(3),)]).orderBy("at").collect()] == [-3, 12_001]


def test_shuffles_go_with_their_step_and_rows_are_made_once(spark, table):
    setting, runs = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    own = spark.conf.getAll.get(setting)
    once = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        once.add(1)
        return v

    def change(rows):
        runs.append(spark.conf.get(setting))
        return rows.withColumn("value", counted("value"))

    table.update(spark.createDataFrame([(key_of(5),)], "key string"), change)
    assert runs == ["true"] and once.value == 100 and spark.conf.getAll.get(setting) == own


def test_failed_and_competing_commits_change_nothing(spark, table, monkeypatch):
    delta = spark.createDataFrame([(key_of(1), dt.datetime(2023, 11, 14), 0, 0)], "key string, at timestamp, value long, group long")
    with pytest.raises(Exception, match="broken"):
        table.update(delta, lambda rows: rows.withColumn("value", F.raise_error(F.lit("broken")).cast("long")))
    assert table.versions() == [1] and content(table.read())[key_of(1)] == 1
    other = StoredTable(spark, table.root, table.key, table.cluster, 100)
    real = StoredTable._commit

    def late(self, files, version):
        if self is table:
            other.upsert(delta.withColumn("value", F.lit(77).cast("long")))
        return real(self, files, version)

    monkeypatch.setattr(StoredTable, "_commit", late)
    with pytest.raises(Conflict):
        table.upsert(delta)
    assert table.versions() == [1, 2] and content(table.read())[key_of(1)] == 77


def test_empty_tables_and_null_keys(spark, tmp_path):
    schema = "key string, at timestamp, value long"
    empty = StoredTable(spark, str(tmp_path / "e"), ("key",), ("at",), 10)
    with pytest.raises(ValueError):
        empty.read()
    rows = spark.createDataFrame([("a", None, 1), (None, dt.datetime(2024, 1, 1), 2), ("a", dt.datetime(2024, 1, 2), 3)], schema)
    empty.create(rows)
    empty.upsert(spark.createDataFrame([("a", None, 9), (None, None, 8)], schema))
    assert sorted((str(r["key"]), r["value"]) for r in empty.read().collect()) == [("None", 2), ("None", 8), ("a", 9)]
    empty.delete(spark.createDataFrame([("a",)], "key string"))
    assert empty.read().count() == 2
    empty.update(empty.read(), lambda rows: rows.where("false"))
    none = StoredTable(spark, str(tmp_path / "n"), ("key",), ("at",), 10)
    none.create(rows.where("false"))
    assert none.read().schema == rows.schema and none.read().count() == 0 and none.lookup([("a",)]).count() == 0
    none.upsert(rows.where("value = 1"))
    none.delete(spark.createDataFrame([("a",)], "key string"))
    assert none.read().schema == rows.schema and none.read().count() == 0 and none.read(2).count() == 1
