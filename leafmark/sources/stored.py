"""Tables in a folder with versions: copy-on-write updates and reads that skip files.

A table's rows lie in Parquet files of ranges of the clustering columns, sorted within. A version is a list of files, a row each, with the least and
greatest value of every indexed column and a bitmap of hashes of the key; it is written beside its place and moved there, which fails if another writer
was first. Files are never changed: an update finds the files that hold touched keys, writes their rows anew and commits a version without
the old ones, so readers of an earlier version keep what they see, and an update that fails leaves the last version as it was.

Reads by key or by range look at the list first and open only files that may hold a match; within these Parquet's own statistics and
Bloom filters go on, which are sized for a file's rows. Lists have a row a file, and files of a large table have more rows, so that lists stay small next
to the table; file names that a read needs go through the driver, as in any scan of files. Shuffles of a step are dropped once it is done, and an update
writes its rows beside the table before they are dealt to files, so that two large shuffles are never there at once.
Rows with a null key are never touched by an update nor found by a lookup; keys that repeat are updated together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.sources.folders import open_root
from leafmark.sources.shared import shuffles_dropped

#: Bits of a bitmap (what bitmap_construct_agg makes), and rows of a file: a bitmap then lets about a seventh of other keys pass. Larger files have a bitmap
#: for as many rows each.
BITS, FILE_ROWS = 1 << 15, 5000
#: Files of a large table, about, and files that a task writes.
MOST_FILES, TASK_FILES = 4096, 8


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


@dataclass
class StoredTable:
    """A versioned table below root. key: the columns that updates and lookups go by; cluster: the order of rows; both are indexed.

    file_rows: rows of a file in tables of up to MOST_FILES times as many.
    """

    spark: SparkSession
    root: str
    key: tuple[str, ...]
    cluster: tuple[str, ...]
    file_rows: int = FILE_ROWS
    indexed: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        self.indexed = tuple(dict.fromkeys((*self.cluster, *self.key)))

    # Versions.

    def versions(self) -> list[int]:
        fs, root = open_root(self.root)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/versions", allow_not_found=True))
        return sorted(int(f.base_name[1:]) for f in found if f.base_name[0] == "v" and f.base_name[1:].isdigit())

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a version, the newest by default: file, rows, least_* and most_* of indexed columns, keys."""
        versions = self.versions()
        if not versions:
            raise ValueError(f"no table in {self.root}")
        return self.spark.read.parquet(f"{self.root}/versions/v{versions[-1] if version is None else version}")

    def _commit(self, files: DataFrame, version: int) -> int:
        beside = f"{self.root}/versions/_{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(beside)
        fs, root = open_root(self.root)
        place = f"{root}/versions/v{version}"
        if fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            raise Conflict(f"version {version} of {self.root} is there already")
        try:  # moving onto a folder that has come meanwhile fails
            fs.move(f"{root}/versions/{beside.rpartition('/')[2]}", place)
        except OSError as error:
            raise Conflict(f"version {version} of {self.root} is there already") from error
        return version

    # Reading.

    def read(self, version: int | None = None) -> DataFrame:
        return self._open(self.files(version))

    def _open(self, files: DataFrame) -> DataFrame:
        return self._named([r["file"] for r in files.select("file").collect()])

    def _named(self, names: list[str]) -> DataFrame:
        if not names:
            fs, root = open_root(self.root)
            with fs.open_input_stream(f"{root}/schema") as stream:
                return self.spark.createDataFrame([], stream.read().decode())
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names])

    def between(self, column: str, low: Column, high: Column, version: int | None = None) -> DataFrame:
        """Rows with low <= column < high."""
        may = (F.col(f"most_{column}") >= low) & (F.col(f"least_{column}") < high)
        return self._open(self.files(version).where(may)).where((F.col(column) >= low) & (F.col(column) < high))

    def lookup(self, keys: list[tuple], version: int | None = None) -> DataFrame:
        """Rows with one of these keys, a stated list of tuples in order of the key columns."""
        # In the columns' own types: the hash of 3 as an integer is not that of 3 as a long.
        kinds = [self.files(version).schema[f"least_{c}"].dataType for c in self.key]
        wanted = [tuple(F.lit(v).cast(t) for v, t in zip(k, kinds, strict=True)) for k in keys]
        if not wanted:
            return self.read(version).where("false")
        may = reduce(lambda a, b: a | b, [self._may_hold(k) for k in wanted])
        is_one = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(self.key, k, strict=True)]) for k in wanted])
        return self._open(self.files(version).where(may)).where(is_one)

    def _place(self, values: tuple[Column, ...], bits: Column) -> Column:
        return F.pmod(F.xxhash64(*values), bits)

    def _may_hold(self, values: tuple[Column, ...]) -> Column:
        """Whether a file's bounds and bitmap leave room for this key."""
        within = reduce(lambda a, b: a & b, [F.lit(True), *[(F.col(f"least_{c}") <= v) & (F.col(f"most_{c}") >= v) for c, v in zip(self.key, values, strict=True)]])
        at = self._place(values, F.length("keys") * 8)
        byte = F.conv(F.hex(F.substring("keys", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return within & (F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1)

    # Writing.

    def _written(self, rows: DataFrame, count: int, total: int) -> DataFrame:
        """Rows, count of them, as new files in clustered order, and what the list says of them. total: rows of the whole table."""
        size = max(self.file_rows, -(-total // MOST_FILES))
        part = f"data/{uuid.uuid4().hex}"
        ordered = rows.repartitionByRange(max(1, -(-count // (size * TASK_FILES))), *self.cluster).sortWithinPartitions(*self.cluster)
        writer = ordered.write.option("maxRecordsPerFile", size).option("compression", "zstd")
        for c in self.key:  # a filter of no stated number of values takes 1 MB, whatever the file's rows
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", size)
        writer.parquet(f"{self.root}/{part}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{part}")
        name = F.concat(F.lit(f"{part}/"), F.col("_metadata.file_name"))
        maps = max(1, -(-size // FILE_ROWS))
        place = self._place(tuple(F.col(c) for c in self.key), F.lit(BITS * maps))
        named = back.withColumns({"file": name, "__at": place})
        bounds = [f(c).alias(f"{n}_{c}") for c in self.indexed for f, n in ((F.min, "least"), (F.max, "most"))]
        if maps == 1:
            return named.groupBy("file").agg(F.count("*").alias("rows"), *bounds, F.bitmap_construct_agg("__at").alias("keys"))
        # Bitmaps of a file, one after another: the byte of a place is found as in a single one.
        by_map = named.groupBy("file", F.floor(F.col("__at") / BITS).cast("int").alias("__map")).agg(F.count("*").alias("rows"), *bounds, F.bitmap_construct_agg(F.col("__at") % BITS).alias("__bits"))
        none = F.lit(bytes(BITS // 8))
        whole = F.aggregate(F.sequence(F.lit(0), F.lit(maps - 1)), F.lit(b""), lambda all_bits, i: F.concat(all_bits, F.coalesce(F.element_at("__maps", i), none)))
        again = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in self.indexed for f, n in ((F.min, "least"), (F.max, "most"))]
        files = by_map.groupBy("file").agg(F.sum("rows").alias("rows"), *again, F.map_from_entries(F.collect_list(F.struct("__map", "__bits"))).alias("__maps"))
        return files.withColumn("keys", whole).drop("__maps")

    def create(self, rows: DataFrame) -> int:
        """Version 1: all rows, clustered."""
        fs, root = open_root(self.root)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/schema") as out:
            out.write(rows.schema.simpleString().encode())
        with shuffles_dropped(self.spark):
            count = rows.count()
            return self._commit(self._written(rows, count, count), 1)

    def touched(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The files of a version that hold one of these keys; only key columns of the files are read."""
        files = self.files(version)
        if files.isEmpty():
            return files
        # Names go as their hashes: what is shuffled has no text that is longer than the keys.
        name = F.substring_index(F.col("_metadata.file_path"), "/", -3)
        same = keys.select(*self.key).distinct()
        held = self._open(files).select(*self.key, F.xxhash64(name).alias("__file")).join(same, list(self.key), "left_semi").select("__file").distinct()
        return files.join(held, F.xxhash64("file") == F.col("__file"), "left_semi")

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commit a version in which change(rows of touched files) stands for these rows, and return its number.

        change gets whole files, rows of other keys among them, and gives all rows that are to be there, new ones included.
        """
        version = self.versions()[-1]
        files = self.files(version)
        with shuffles_dropped(self.spark):
            names = [r["file"] for r in self.touched(keys, version).select("file").collect()]
            before = self._named(names) if names else self.read(version).where("false")
            # Rows are made once, and what making them has shuffled is gone before they are dealt to files.
            made = f"{self.root}/data/_{uuid.uuid4().hex}"
            change(before).select(*before.columns).write.option("compression", "zstd").parquet(made)
            try:
                rows = self.spark.read.schema(before.schema).parquet(made)
                count = rows.count()
                kept = files.where(~F.col("file").isin(names)) if names else files
                total = count + (kept.agg(F.sum("rows")).first()[0] or 0)
                new = self._written(rows, count, total) if count else files.where("false")
                return self._commit(kept.unionByName(new), version + 1)
            finally:
                fs, place = open_root(made)
                fs.delete_dir(place)

    def upsert(self, delta: DataFrame) -> int:
        """Rows of delta in place of those with their keys, or as new ones."""
        return self.update(delta, lambda rows: rows.join(delta.select(*self.key).distinct(), list(self.key), "left_anti").unionByName(delta.select(*rows.columns)))

    def delete(self, keys: DataFrame) -> int:
        return self.update(keys, lambda rows: rows.join(keys.select(*self.key).distinct(), list(self.key), "left_anti"))
