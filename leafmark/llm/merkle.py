"""Merkle manifest of a dataset as a persistent tree with path copying.

1. Every document becomes a leaf digest; its text is read once. Leaves are sorted by range within their source and numbered, so
   that place // 3**LEVELS names an aligned block of 3**LEVELS leaves, the whole subtree below one node.
2. A task builds the subtrees of its blocks; only the digest of each block's top goes on. Tops are the leaves of the next, 3**LEVELS times
   smaller, distributed level, until each source has its subroot; subroots, ordered by source, form one more tree.
3. From the top down, every block gets its path: the digests beside it on the way to the root.
4. A tampered leaf makes a version of the tree: the nodes above it within its block are copied, all others are shared
   with the original, and the version goes on along the block's path. Versions that end in the same top share all of it.

A block has a fixed number of leaves, so memory is bounded, and a source with a third of all rows is just more blocks.

Digests are lower-case hex SHA-256 of the concatenated inputs. Cases: nulls are `-`; rows of one source ascend by doc_id (null first) and
then by leaf digest, so rows that repeat have places in any order and equal digests, but proofs of their own; a null
source is a source of its own, before all others. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import Scratch, materialize, small_batches

ARITY = 3
#: Levels of a tree that one task builds at once, and rows that a task gives back or gets at once.
LEVELS = 6
BATCH = 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(text: Column) -> Column:
    """The leaf of a row, with this text in place of its own."""

    def field(name: str) -> Column:
        value = (text if name == "text" else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered): tree names the source and sorts as sources do; tampered is null where the leaf stays as it is."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = F.when(hit & F.contains("text", F.lit("\n")), leaf_digest(F.replace("text", F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.select("doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("leaf"), other.alias("tampered"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (with tree) with place, from 0 within each tree in the given order, and n, the tree's number of rows.

    Rows are sorted by range; a tree that spans several ranges goes on where the one before ends. Only one row a tree and
    range is gathered to know where that is. A running number keeps equal rows from being one range.
    """
    fixed = scratch.keep(rows.withColumn("__own", F.monotonically_increasing_id()))
    ordered = ["tree", *order, "__own"]
    spread = fixed.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("__own")
    at = scratch.keep(spread.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)))
    runs = at.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__many"))
    by_tree = Window.partitionBy("tree").orderBy("__range")
    earlier = F.coalesce(F.sum("__many").over(by_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__many").over(by_tree.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = runs.select("tree", "__range", (earlier - F.col("__first")).alias("__shift"), whole.alias("n"))
    return at.join(starts, ["tree", "__range"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtree(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level, its leaves first."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def beside(nodes: list[list[str]], i: int) -> list[tuple[str, str]]:
    """For a leaf of a block: what stands left and right of its ancestors in their runs, level by level."""
    out = []
    for level in nodes[:-1]:
        run = i // ARITY * ARITY
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + ARITY])))
        i //= ARITY
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The top of a tree from one leaf and what stands beside it: a copy of the path."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another; a partition is sorted by block and holds whole ones."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (rows[0]["tree"], rows[0]["block"]) != (row["tree"], row["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _by_block(nodes: DataFrame) -> DataFrame:
    """Whole blocks in their tasks, in order of place."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _flushed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


NODE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])
PATH = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("top", pa.string())])
PATH_SQL = "tree string, block long, left array<string>, right array<string>, top string"


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY**levels).cast("long"))


def block_tops(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, n, hash) of nodes -> the same of the tops of their blocks; n counts the nodes of each tree."""

    def tops(batches):
        def rows():
            for block in _blocks(batches):
                n = block[0]["n"]
                top = subtree([r["hash"] for r in block], min(levels, height(n)))[-1][0]
                yield {"tree": block[0]["tree"], "place": block[0]["block"], "n": -(-n // ARITY**levels), "hash": top}

        return _flushed(rows(), NODE)

    return _by_block(_blocked(nodes, levels).select("tree", "block", "place", "n", "hash")).mapInArrow(tops, "tree string, place long, n long, hash string")


def _with_paths(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Nodes in whole blocks, each block after the row with its path."""
    return _by_block(_blocked(nodes, levels).unionByName(paths.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True))


def node_paths(nodes: DataFrame, paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The path of every node, as paths of the blocks that they are the tops of."""

    def down(batches):
        def rows():
            for head, *block in _blocks(batches):
                nodes_ = subtree([r["hash"] for r in block], min(levels, height(block[0]["n"])))
                for i, r in enumerate(block):
                    path = beside(nodes_, i)
                    yield {
                        "tree": r["tree"], "block": r["place"], "left": [a for a, _ in path] + head["left"], "right": [b for _, b in path] + head["right"], "top": head["top"],
                    }

        return _flushed(rows(), PATH)

    return _with_paths(nodes, paths, levels).mapInArrow(down, PATH_SQL)


def grown(nodes: DataFrame, levels: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees over (tree, place, n, hash), each much smaller than the one before, and (tree, hash) of their roots."""
    stories = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        tops = scratch.keep(block_tops(stories[-1], levels))
        most = -(-most // ARITY**levels)
        if most <= 1:
            return stories, tops.select("tree", "hash")
        stories.append(tops)


def lowered(stories: list[DataFrame], paths: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """Paths of the lowest blocks from those above the roots."""
    for nodes in reversed(stories[1:]):
        paths = scratch.keep(node_paths(nodes, paths, levels))
    return paths


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    scratch = Scratch()
    at = scratch.keep(numbered(leaves(docs), ["doc_id", "leaf"], scratch))
    with small_batches(docs.sparkSession, BATCH):
        stories, subroots = grown(at.select("tree", "place", "n", F.col("leaf").alias("hash")), levels, scratch)
        named = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), ["source"], scratch)
        named = scratch.keep(named)
        over, roots = grown(named.drop("source"), levels, scratch)
        none = F.array().cast("array<string>")
        top = roots.select("tree", F.lit(0).cast("long").alias("block"), none.alias("left"), none.alias("right"), F.col("hash").alias("top"))
        # Each subroot's own path, which all blocks of its source end in.
        above = node_paths(named.drop("source"), lowered(over, top, levels, scratch), levels).select(F.col("block").alias("place"), "left", "right", "top")
        # Left of the first "|" stands the subroot.
        ends = named.join(above, "place").select(
            F.col("source").alias("tree"), F.lit(0).cast("long").alias("block"), "left", "right", F.concat_ws("|", "hash", "top").alias("top")
        )
        paths = lowered(stories, scratch.keep(ends), levels, scratch)
        out = materialize(_with_paths(at.select("tree", "place", "n", "doc_id", "leaf", "tampered"), paths, levels).mapInArrow(_proofs(levels), RESULT_SQL))
    scratch.drop(docs.sparkSession)
    return out


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
RESULT_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(levels: int):
    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for head, *block in _blocks(batches):
                nodes = subtree([r["leaf"] for r in block], min(levels, height(block[0]["n"])))
                path = list(zip(head["left"], head["right"], strict=True))
                beyond = "".join(a + b for a, b in path).encode()
                subroot, root = head["top"].split("|")
                ends: dict[str, str] = {}  # versions with the same top of the block share the nodes above it
                for i, r in enumerate(block):
                    own = beside(nodes, i)
                    proof = hashlib.sha256("".join(a + b for a, b in own).encode())
                    proof.update(beyond)
                    version = fold(r["tampered"] or r["leaf"], own)
                    if version not in ends:
                        ends[version] = fold(version, path)
                    yield {
                        "doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": subroot, "root": root, "proof_sha256": proof.hexdigest(), "folded_root": ends[version], "verified": ends[version] == root,
                    }

        return _flushed(rows(), RESULT)

    return proofs


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
with recursive fields as (
  select doc_id, source,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as front,
         text, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
           lambda crc, byte: list_reduce([xor(crc, byte)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents),
leaves as (
  select doc_id, coalesce('s' || source, 'n') as tree, sha256(front || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         sha256(front || coalesce(strlen(own) || ':' || own, '-')) as other
  from (select *, case when xor(crc, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as own from fields)),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from leaves),
nodes as (
  select tree, 0 as level, place, leaf as hash, n from placed
  union all
  select tree, level + 1, place // 3, sha256(string_agg(hash, '' order by place)), (n + 2) // 3 from nodes where n > 1 group by tree, level, place // 3, n),
subroots as (select tree, hash, row_number() over (order by tree) - 1 as place, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, place, hash, n from subroots
  union all
  select level + 1, place // 3, sha256(string_agg(hash, '' order by place)), (n + 2) // 3 from tops where n > 1 group by level, place // 3, n),
siblings as (
  select tree, level, place, n,
         coalesce(string_agg(hash, '' order by place) over (partition by tree, level, place // 3 order by place rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(hash, '' order by place) over (partition by tree, level, place // 3 order by place rows between 1 following and unbounded following), '') as r
  from (select * from nodes where n > 1 union all
        select '', level, place, hash, n from tops where n > 1)),
climb as (
  select p.doc_id, p.place as start, p.leaf, p.tree as own, s.hash as subroot, p.tree as tree, 0 as level, p.place as place, s.place as up, p.other as hash, '' as proof
  from placed p join subroots s using (tree)
  union all
  select c.doc_id, c.start, c.leaf, c.own, c.subroot, case when s.place is null then '' else c.tree end, case when s.place is null then 0 else c.level + 1 end,
         case when s.place is null then c.up else c.place // 3 end, c.up, case when s.place is null then c.hash else sha256(s.l || c.hash || s.r) end,
         c.proof || coalesce(s.l, '') || coalesce(s.r, '')
  from climb c left join siblings s on s.tree = c.tree and s.level = c.level and s.place = c.place
  where s.place is not null or c.tree <> '')
select c.doc_id, c.leaf, c.subroot, t.hash as root, sha256(c.proof) as proof_sha256, c.hash as folded_root, c.hash = t.hash as verified
from climb c join tops t on t.n = 1
where c.tree = '' and c.level = (select max(level) from tops)
"""
