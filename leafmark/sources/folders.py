"""Artifact folders as a Spark data source: one row per folder when read, files under their own names when written.

Reading: the folders right below a path are dealt to partitions in bundles; a task lists its folders, with whatever is nested in
them, and reads the contents of wanted names only. All files of a folder are in one row, so records and checks of folders need no shuffle.
What starts with `_` or `.` at the top is not a folder of artifacts.

Writing: rows of (folder, name, body) become files of these names. A file is written beside its place and then moved there, so nobody
sees half of it; a task that is repeated writes the same names again. Each task leaves a list of its files, and the job's commit names the
lists; an aborted job takes back the files of finished tasks.

Packed writing: a small file takes a whole block of a disk, so folders of a few kilobytes take many times their bytes. With the option packed, whole
folders go into archives (`.tar.zst`; unpacked, they give the same folders and files), written beside their place and moved there by the job's commit.
Such a root is written once, by rows that are dealt so that those of a folder follow one another in one task. It is read like any other, an archive by a task.

    spark.dataSource.register(ArtifactFolders)
    spark.read.format("artifact_folders").option("names", "metadata.json,ocr.json").load(root)
    files.write.format("artifact_folders").mode("append").save(root)
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "folder string, files array<struct<name string, path string, size bigint, body string>>"
#: Folders of one partition.
BUNDLE = 256
#: Folders and bytes of contents after which a task begins another archive.
PACK_FOLDERS, PACK_BYTES = 4096, 128 << 20
#: Where a packed root has its archives and their list.
PACKS, LISTED = "_packs", "_SUCCESS"


def open_root(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the place in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Bundle(InputPartition):
    folders: tuple[str, ...]


@dataclass
class Pack(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    listed: str


@dataclass
class Packed(WriterCommitMessage):
    names: tuple[str, ...]


def is_packed(fs: pyarrow.fs.FileSystem, root: str) -> bool:
    return fs.get_file_info(f"{root}/{PACKS}").type != pyarrow.fs.FileType.NotFound


class ArtifactFolders(DataSource):
    """See the module's text. Options: path; names, whose contents are read (none by default); bundle, folders of one partition; packed, to write archives."""

    @classmethod
    def name(cls) -> str:
        return "artifact_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        names = tuple(filter(None, self.options.get("names", "").split(",")))
        return FolderReader(self.options["path"], names, int(self.options.get("bundle", BUNDLE)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        packed = str(self.options.get("packed", "false")).lower() == "true"
        return (PackWriter if packed else FolderWriter)(self.options["path"], overwrite)


class FolderReader(DataSourceReader):
    def __init__(self, path: str, names: tuple[str, ...], bundle: int) -> None:
        self.path, self.names, self.bundle = path, names, bundle

    def partitions(self) -> list[Bundle | Pack]:
        fs, root = open_root(self.path)
        if is_packed(fs, root):
            with fs.open_input_stream(f"{root}/{PACKS}/{LISTED}", compression=None) as stream:
                return [Pack(name) for name in json.loads(stream.read())] or [Bundle(())]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        folders = sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory and f.base_name[0] not in "_.")
        return [Bundle(tuple(folders[i : i + self.bundle])) for i in range(0, len(folders), self.bundle)] or [Bundle(())]

    def _unpacked(self, name: str) -> Iterator[tuple]:
        fs, root = open_root(self.path)
        with fs.open_input_stream(f"{root}/{PACKS}/{name}", compression="zstd") as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for folder, members in groupby(tar, lambda m: m.name.partition("/")[0]):
                files = {}  # of a name that was written again, the last
                for m in members:
                    own = m.name.rpartition("/")[2]
                    if not own.startswith("."):
                        body = tar.extractfile(m).read().decode("utf-8", "replace") if own in self.names else None
                        files[m.name] = (m.name[len(folder) + 1 :], m.name, m.size, body)
                if folder[0] not in "_.":
                    yield folder, sorted(files.values())

    def read(self, partition: Bundle | Pack) -> Iterator[tuple]:
        if isinstance(partition, Pack):
            yield from self._unpacked(partition.name)
            return
        fs, root = open_root(self.path)
        for folder in partition.folders:
            files = []
            for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{folder}", recursive=True)):
                if f.is_file and not f.base_name.startswith("."):
                    body = None
                    if f.base_name in self.names:
                        with fs.open_input_stream(f.path) as stream:
                            body = stream.read().decode("utf-8", "replace")
                    name = f.path[len(root) + len(folder) + 2 :]
                    files.append((name, f"{folder}/{name}", f.size, body))
            yield folder, sorted(files)


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        if overwrite:
            fs, root = open_root(path)
            fs.delete_dir_contents(root, missing_dir_ok=True)
        self._expect_room()

    def _expect_room(self) -> None:
        if is_packed(*open_root(self.path)):
            raise FileExistsError(f"{self.path} holds packed folders, which are written once")

    def write(self, iterator: Iterator) -> Written:
        fs, root = open_root(self.path)
        log, made = f"{root}/_commits/{self.job}", []
        fs.create_dir(log, recursive=True)
        for row in iterator:
            folder, name, body = row["folder"], row["name"], row["body"]
            place = f"{root}/{folder}/{name}"
            above, _, own = place.rpartition("/")
            fs.create_dir(above, recursive=True)
            beside = f"{above}/.{own}.{uuid.uuid4().hex}"
            with fs.open_output_stream(beside, compression=None) as out:
                out.write((body or "").encode() if not isinstance(body, (bytes, bytearray)) else body)
            fs.move(beside, place)
            made.append(f"{folder}/{name}")
        listed = f"{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{log}/{listed}", compression=None) as out:
            out.write(json.dumps(made).encode())
        return Written(listed)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_root(self.path)
        fs.create_dir(f"{root}/_commits/{self.job}", recursive=True)
        with fs.open_output_stream(f"{root}/_commits/{self.job}/_SUCCESS", compression=None) as out:
            out.write(json.dumps(sorted(m.listed for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_root(self.path)
        for m in filter(None, messages):
            with fs.open_input_stream(f"{root}/_commits/{self.job}/{m.listed}") as stream:
                for path in json.loads(stream.read()):
                    fs.delete_file(f"{root}/{path}")
            fs.delete_file(f"{root}/_commits/{self.job}/{m.listed}")


class PackWriter(FolderWriter):
    """Whole folders into archives; see the module's text."""

    def _expect_room(self) -> None:
        super()._expect_room()
        fs, root = open_root(self.path)
        if any(f.base_name[0] not in "_." for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))):
            raise FileExistsError(f"{self.path} holds folders already")

    @property
    def _beside(self) -> str:
        return f"{open_root(self.path)[1]}/_packing_{self.job}"

    def write(self, iterator: Iterator) -> Packed:
        fs, _ = open_root(self.path)
        fs.create_dir(self._beside, recursive=True)
        names: list[str] = []
        with ExitStack() as stack:
            tar, last, folders, size = None, None, 0, 0
            for row in iterator:
                folder, name, body = row["folder"], row["name"], row["body"]
                content = body if isinstance(body, (bytes, bytearray)) else (body or "").encode()
                if folder != last:
                    if tar is None or folders == PACK_FOLDERS or size > PACK_BYTES:
                        stack.close()
                        names.append(f"{uuid.uuid4().hex}.tar.zst")
                        out = stack.enter_context(fs.open_output_stream(f"{self._beside}/{names[-1]}", compression="zstd"))
                        tar, folders, size = stack.enter_context(tarfile.open(fileobj=out, mode="w|")), 0, 0
                    last, folders = folder, folders + 1
                info = tarfile.TarInfo(f"{folder}/{name}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                tar.members.clear()  # else it keeps them all
                size += len(content)
        return Packed(tuple(names))

    def commit(self, messages: list[Packed | None]) -> None:
        fs, root = open_root(self.path)
        fs.create_dir(self._beside, recursive=True)
        with fs.open_output_stream(f"{self._beside}/{LISTED}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        self._expect_room()
        fs.move(self._beside, f"{root}/{PACKS}")  # fails if another job was first

    def abort(self, messages: list[Packed | None]) -> None:
        fs, _ = open_root(self.path)
        if fs.get_file_info(self._beside).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(self._beside)
