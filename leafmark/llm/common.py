"""What several operators share: written intermediate tables, batch sizes, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder, which driver and executors share.

    The folder is the one in spark.checkpoint.dir. Where none is set, a temporary one is taken on a local master; on a
    cluster it would be one machine's own, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Later jobs start from these files, so a lost executor costs no recomputation of what led here.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediate tables that are dropped together once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession)
        self.paths.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


#: Bits of a sieve, and how many of them are in one row of it.
SIEVE_BITS, SIEVE_ROW = 1 << 23, 1 << 15


def sifted(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df with __may: false for rows whose key is surely not among the wanted keys (one column).

    A bitmap of SIEVE_BITS bits, whatever the tables' sizes, is made from hashes of the wanted keys and broadcast. Rows that do not
    pass need no shuffle to meet the wanted ones. A sieve that has filled up lets everything pass.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(SIEVE_BITS))
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("p")).select(F.floor(F.col("p") / SIEVE_ROW).alias("__sieve_row"), (F.col("p") % SIEVE_ROW).alias("p"))
    rows = bits.groupBy("__sieve_row").agg(F.bitmap_construct_agg("p").alias("__sieve_bits"))
    at = place(key)
    joined = df.withColumn("__sieve_at", at).withColumn("__sieve_own", F.floor(F.col("__sieve_at") / SIEVE_ROW)).join(F.broadcast(rows), F.col("__sieve_own") == F.col("__sieve_row"), "left")
    byte = F.conv(F.hex(F.substring("__sieve_bits", (F.floor((F.col("__sieve_at") % SIEVE_ROW) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.floor(byte / F.pow(F.lit(2.0), F.col("__sieve_at") % 8)) % 2 == 1
    return joined.withColumn("__may", F.coalesce(bit, F.lit(False))).drop("__sieve_at", "__sieve_own", "__sieve_row", "__sieve_bits")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.getAll.get(name)
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(29)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
#: Bytes hashed at a time, and an odd base with its powers and those of its inverse modulo 2**64.
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, lower-cased, in order. Words are runs of anything but ASCII white space."""
    return raw_word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))


def raw_word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text's UTF-8 bytes as they are.

    A word's hash comes from prefix sums of its bytes' random values times powers of an odd base, so the cost is
    a few array operations a byte. Long texts are hashed piece by piece, between words.
    """
    raw = np.frombuffer(text, np.uint8)
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, side="right")))
        piece = raw[low : ends[to - 1]]
        if len(piece) > _PIECE:  # one word longer than a piece
            up, down = _powers(_BASE, len(piece)), _DOWN
        else:
            up, down = _UP[: len(piece)], _DOWN
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up, out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix64(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; order matters. Empty where there are fewer than n words."""
    k = len(words) - n + 1
    if k <= 0:
        return words[:0]
    out = words[:k].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + k]
    return mix64(out)


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(src, dst) links of longs -> (node, component), component being the smallest node reachable.

    Alternates two star operations: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones are. Trees become stars in a logarithmic number of rounds. Each
    round is two aggregations and two joins over the links; nothing is gathered per node, and a hub
    is only a skewed join key, which adaptive execution splits. Rounds are cut by written tables.
    """

    def stars(links: DataFrame, larger: bool) -> DataFrame:
        if larger:
            seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            seen = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = seen.join(least, "u")
        if larger:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()

    write = scratch.keep if scratch else materialize
    links = write(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    )
    before = mark(links)
    while before[0]:
        links = write(stars(stars(links, True), False))
        after = mark(links)
        if after == before:
            break
        before = after
    # Every link now leads from a node to the smallest node of its component.
    tops = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
