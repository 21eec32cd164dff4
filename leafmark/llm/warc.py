"""WARC archives as a chunked record table.

Writing: every task streams its pages into gzip archives, one member a record, in a folder that all
machines share. A payload reaches the task in its row's Arrow buffer and is compressed from there slice by slice, so that
cost is linear in its bytes and nothing as large as a record is made besides; payloads of revisits are not sent. A table lists the archives that
successful tasks have written; files of failed attempts are never in it. Of pages with equal payloads of at
least MIN_REVISIT bytes, that with the smallest page_id is a response and the others revisit it; roles come
from digests, which is all that is shuffled to find them.

Reading: archives are streamed back into rows of (record, chunk number), each with the bytes and the digest of the
payload so far. The last chunk of a record carries its whole digest, so nothing is gathered to get it and no
record is held in memory, however large.

Cases: a null payload is an empty one; payloads under MIN_REVISIT bytes are always responses; rows that repeat a
page_id and payload are all responses if they hold the smallest id, else all revisits, with record ids of their own; a null page_id counts as
larger than any other, and equal payloads that only have null ids are all responses. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import materialize, shared_dir, sifted, small_batches

CHUNK = 1 << 20
MIN_REVISIT = 100
#: An archive that has grown beyond this is closed and the task goes on with another.
ARCHIVE_BYTES = 1 << 30


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce("html", F.lit(""))
    described = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    digests = described.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    first = digests.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    later = digests.join(first, "payload_digest").where("page_id is null or page_id > refers_to").distinct()
    later = later.select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "refers_to")
    # Only pages that pass a sieve of the later copies' ids are shuffled; payloads of all others stay where they are.
    rows = sifted(described, F.col("page_id"), later.select("__id"))
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest"))
    # By page_id, as one digest may hold a third of all payloads; the ids are the side that is hashed.
    met = rows.where("__may").drop("__may").join(later.hint("shuffle_hash"), same, "left").drop("__id", "__digest")
    return rows.where("not __may").drop("__may").withColumn("refers_to", F.lit(None).cast("long")).unionByName(met)


def slices(column: pa.Array, i: int, size: int = CHUNK) -> Iterator[memoryview]:
    """The bytes of one value of a string column, a slice of its buffer at a time, without a copy."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    start, end = map(int, np.frombuffer(offsets, wide, column.offset + len(column) + 1)[column.offset + i : column.offset + i + 2])
    whole = memoryview(data)[start:end] if data is not None else memoryview(b"")
    for at in range(0, len(whole), size):
        yield whole[at : at + size]


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return pyarrow.fs.FileSystem.from_uri(uri)


def _head(page: dict, record_type: str, http_bytes: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(page['url'] or '').encode('ascii', 'backslashreplace').decode().replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha256:{page['payload_digest']}",
        f"X-Page-ID: {'' if page['page_id'] is None else page['page_id']}",
        f"X-Payload-Length: {page['payload_bytes']}",
    ]
    if page["refers_to"] is not None:
        lines += [f"X-Refers-To-Page-ID: {page['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = 0 if page["refers_to"] is not None else page["payload_bytes"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {http_bytes + body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(described: DataFrame, folder: str) -> DataFrame:
    """Write records below folder, a gzip member each; the written table of archives: archive, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, made = None, []

        def put(data: bytes) -> None:
            made[-1][2] += out.write(data)

        for batch in batches:
            payloads = batch.column("payload")
            for i, page in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                if out is not None and made[-1][2] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    made.append([f"part-{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = fs.open_output_stream(f"{root}/{made[-1][0]}", compression=None)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                put(packer.compress(_head(page, "response" if page["refers_to"] is None else "revisit", len(http)) + http))
                if page["refers_to"] is None:
                    for piece in slices(payloads, i):
                        put(packer.compress(piece))
                put(packer.compress(b"\r\n\r\n") + packer.flush())
                made[-1][1] += 1
        if out is not None:
            out.close()
        names, records, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    sent = described.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
    with small_batches(described.sparkSession, 500):
        return materialize(sent.select(*columns).mapInArrow(write, "archive string, records long, bytes long"))


def _members(stream, size: int = CHUNK) -> Iterator[tuple[bool, bytes]]:
    """(opens a member, bytes) of a gzip file of many members, in pieces of limited size."""
    raw, unpacker, opens = b"", zlib.decompressobj(31), True
    while True:
        raw = raw or stream.read(size)
        if not raw:
            return
        piece = unpacker.decompress(raw, size)
        raw = unpacker.unconsumed_tail
        if piece or unpacker.eof:
            yield opens, piece
            opens = False
        if unpacker.eof:
            # What follows the member; the tail of the last call is part of it.
            raw, unpacker, opens = unpacker.unused_data, zlib.decompressobj(31), True


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def records(stream, size: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive; see read_archives()."""
    fields, left, waiting, no, total, digest = None, 0, b"", 0, 0, hashlib.sha256()
    for opens, piece in _members(stream, size):
        if opens:
            fields, waiting, no, total, digest = None, b"", 0, 0, hashlib.sha256()
        if fields is None:
            waiting += piece
            head, mark, rest = waiting.partition(b"\r\n\r\n")
            http, mark_2, rest = rest.partition(b"\r\n\r\n")
            if not mark or not mark_2:
                continue
            fields = _fields(head)
            revisit = fields["WARC-Type"] == "revisit"
            left = 0 if revisit else int(fields["Content-Length"]) - len(http) - 4
            piece = rest
            if left == 0:
                yield _row(fields, no, b"", int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:] if revisit else digest.hexdigest(), True)
                left = -1
        part = piece[: max(0, left)]
        if part:
            left -= len(part)
            total += len(part)
            digest.update(part)
            yield _row(fields, no, part, total, digest.hexdigest(), left == 0)
            no += 1
            left = left or -1


def _row(fields: dict, no: int, data: bytes, total: int, digest: str, last: bool) -> dict:
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": number("X-Page-ID"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "chunk_no": no,
        "payload_so_far": total,
        "digest_so_far": digest,
        "last": last,
        "intact": digest == fields["WARC-Payload-Digest"][7:] if last else None,
        "data": data,
    }


CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, payload_so_far long, digest_so_far string, last boolean, intact boolean"


def read_archives(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives in a table of theirs. Without data only the digests are brought back."""
    columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")] + ["data"] * with_data

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        for pdf in batches:
            for archive in pdf["archive"]:
                with fs.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    rows: list[dict] = []
                    held = 0
                    for row in records(stream):
                        rows.append(row)
                        held += len(row["data"]) * with_data + 300
                        if held > 4 * CHUNK:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                    yield _frame(rows, columns)

    # One task an archive: each is as large as what one task has written.
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return spread.mapInPandas(read, CHUNK_SCHEMA + ", data binary" * with_data)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "intact": "boolean"})


def sound(chunks: DataFrame) -> DataFrame:
    """The last chunk row of each record; a digest that is not the record's own is an error."""
    digest = F.when(F.col("intact"), F.col("digest_so_far")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    return chunks.where("last").withColumn("digest_so_far", digest)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    archives = write_archives(with_roles(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    # The chunked table with its bytes is written; the digests come from it.
    chunks = materialize(read_archives(archives, folder))
    return sound(chunks).select("page_id", F.col("payload_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when d.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when d.page_id > f.first then f.first end as refers_to
from d left join f on f.payload_digest = d.payload_digest and d.payload_bytes >= 100
"""
