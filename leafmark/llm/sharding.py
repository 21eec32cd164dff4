"""Sharding by fixed virtual slots.

Every record is hashed into one of SLOTS virtual slots, whose number never changes. Bytes and rows are
aggregated per slot, and a versioned map says which shard holds each slot. A first map deals slots, largest first, to the
shard with the fewest bytes; rebalancing edits the newest version and adds another, moving little more than the bytes that
shards have too many. Records themselves are only moved where their slot's entry changes.

The map has SLOTS rows whatever the corpus is, so it is made on the driver and broadcast. A record's place in its
shard is the place of its slot there plus its place in the slot, so no task orders a whole shard.

Cases: a null text counts as empty; null doc_ids are hashed with their text like any other; rows equal in doc_id and
text share a slot, in any order; equal texts of different doc_ids have slots of their own, so that a group of copies with a third of all rows
spreads over all slots and shards; an empty table gives no rows, and its map deals slots in turn. Further columns pass through
assign(); those named like a result are replaced.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import materialize, shared_dir

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16
#: How far a shard may be from the mean after the query's edit of the map.
TOLERANCE = 0.001
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32 and virtual_slot."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + OVERHEAD).cast("long"),
            "text_crc32": F.crc32(text),
            "virtual_slot": F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(slots)).cast("int"),
        }
    )


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot: at most one row a slot reaches the driver."""
    sizes = [(0, 0)] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]] = (r["bytes"], r["n"])
    return sizes


def deal(sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """The shard of each slot: largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i)):
        held, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + sizes[slot][0], n + 1, shard))
    return out


def rebalance(shard_of: list[int], sizes: list[tuple[int, int]], shards: int, tolerance: float = 0.01) -> list[int]:
    """The map edited for new sizes or another number of shards.

    Slots of dropped shards go, largest first, to the shard with the fewest bytes. Then the fullest shard gives the emptiest the slot that
    comes nearest to what the one has too much or the other too little, until both are within the tolerance of the mean or no slot
    brings them closer. All other slots stay.
    """
    out, held = list(shard_of), [0] * shards
    owned: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < shards:
            held[shard] += sizes[slot][0]
            owned[shard].append((sizes[slot][0], slot))
        else:
            homeless.append(slot)
    for slots in owned:
        slots.sort()
    mean = sum(s for s, _ in sizes) / shards

    def give(slot: int, to: int) -> None:
        out[slot] = to
        held[to] += sizes[slot][0]
        bisect.insort(owned[to], (sizes[slot][0], slot))

    for slot in sorted(homeless, key=lambda i: (-sizes[i][0], i)):
        give(slot, min(range(shards), key=lambda x: (held[x], x)))
    while shards > 1:
        full, least = max(range(shards), key=lambda x: (held[x], -x)), min(range(shards), key=lambda x: (held[x], x))
        if held[full] - mean <= tolerance * mean and mean - held[least] <= tolerance * mean:
            break
        wanted = min(held[full] - mean, mean - held[least])
        at = bisect.bisect_left(owned[full], (wanted, -1))
        # A slot smaller than the difference of the two brings them closer, whatever it is.
        near = [e for e in owned[full][max(0, at - 1) : at + 1] if 0 < e[0] < held[full] - held[least]]
        if not near:
            break
        size, slot = min(near, key=lambda e: (abs(e[0] - wanted), e))
        owned[full].remove((size, slot))
        held[full] -= size
        give(slot, least)
    return out


def map_table(spark: SparkSession, version: int, shard_of: list[int], sizes: list[tuple[int, int]]) -> DataFrame:
    """One version of the slot-to-shard map as a table."""
    return spark.createDataFrame([(version, slot, shard, *sizes[slot]) for slot, shard in enumerate(shard_of)], MAP_SCHEMA)


def save_map(table: DataFrame, path: str) -> None:
    """Add a version; earlier ones stay readable, and a version that is written again replaces itself."""
    (version,) = table.select("version").distinct().first()
    table.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records (with virtual_slot) with shard and slot, the record's place in its shard, from 0 without gaps."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.drop("shard", "slot").withColumn("__n", F.row_number().over(within) - 1)
    # The map has a fixed number of rows.
    return numbered.join(F.broadcast(placed), "virtual_slot").withColumn("slot", (F.col("__first") + F.col("__n")).cast("long")).drop("__first", "__n")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Write the records by shard; a task writes slots, so a shard is several files of many tasks."""
    records = with_slot(docs, slots)
    sizes = slot_sizes(records, slots)
    table = map_table(docs.sparkSession, 1, deal(sizes, shards), sizes).select("virtual_slot", "shard")
    records.join(F.broadcast(table), "virtual_slot").repartition("virtual_slot").write.partitionBy("shard").parquet(path)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records = materialize(with_slot(docs).select("doc_id", "size", "text_crc32", "virtual_slot"))
    sizes = slot_sizes(records)
    path = shared_dir(spark)
    # The map of a time with one shard less, dealt by rows as sizes in bytes were not known then; it is edited for another shard and these sizes.
    first = deal([(rows, rows) for _, rows in sizes], SHARDS - 1)
    for version, shard_of in ((1, first), (2, rebalance(first, sizes, SHARDS, TOLERANCE))):
        save_map(map_table(spark, version, shard_of, sizes), path)
    return assign(records, load_map(spark, path)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
