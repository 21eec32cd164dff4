"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors (by a 64-bit hash) become one representative with a count, and representatives are rotated onto their principal axes. Ordered
by three axes about the mean they are cut into compact tiles of bounded size, and tiles whose boxes are too far apart for
the threshold are never compared. Two tiles are compared by their leading coordinates first: what the rest can add
is at most the product of the suffix norms, and a pair stops as soon as even that cannot reach the threshold. What is left
is decided by the whole dot product of unit vectors in double precision.

A comparison of two tiles gives each vector's number of links and a spanning forest of them, never the pairs, so
a large group of near copies costs arithmetic but no rows. Components are found over the forests' edges. The work
is that of an exact comparison of all pairs, divided into tiles that any number of tasks share.

The rotation is fitted on a bounded sample (FIT vectors); it decides how early comparisons stop, not what they find.

Cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and form their own component;
vectors of different lengths do not link; null vec_ids are larger than any other and kept; rows that repeat a vec_id are
vectors of their own. An empty table gives an empty result. Further columns, the label among them, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import connected_components, materialize

THRESHOLD = 0.95
TILE = 2048
#: Bytes of rotated vectors that a task holds, and cells on each of two axes by which vectors are sorted.
GROUP_BYTES = 192 << 20
CELLS = 8
FIT = 4096
#: Slack for rounding when pairs are ruled out; decisions are made without it.
SLACK = 1e-5


def is_vector(col: str = "embedding") -> Column:
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, in double precision without overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors about the origin, as columns, most important first."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values, kind="stable")]


def _links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of two rotated tiles, block by block; i < j where the tiles are the same."""
    d = a.shape[1]
    stages = sorted({max(1, d // 4), max(1, d // 2), d})
    suffix = lambda x, k: np.linalg.norm(x[:, k:], axis=1)
    k = stages[0]
    # Leading coordinates and the suffix norm as one more: their product is the upper bound.
    head_a, head_b = (np.column_stack([x[:, :k], suffix(x, k)]).astype(np.float32) for x in (a, b))
    for start in range(0, len(a), 512):
        block = a[start : start + 512]
        i, j = np.nonzero(head_a[start : start + 512] @ head_b.T >= threshold - SLACK)
        if same:
            upper = i + start < j
            i, j = i[upper], j[upper]
        if len(i) > 0.05 * len(block) * len(b):
            exact = block @ b.T
            linked = exact[i, j] >= threshold
            yield i[linked] + start, j[linked]
            continue
        for low in range(0, len(i), 1 << 15):
            p, q = i[low : low + (1 << 15)], j[low : low + (1 << 15)]
            total, done = np.zeros(len(p)), 0
            for k2 in stages:
                total = total + np.einsum("ij,ij->i", block[p, done:k2], b[q, done:k2])
                rest = suffix(block, k2)[p] * suffix(b, k2)[q] if k2 < d else 0.0
                alive = total + rest >= threshold - (SLACK if k2 < d else 0.0)
                p, q, total, done = p[alive], q[alive], total[alive], k2
            yield p + start, q


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n by the pairs."""
    label = np.arange(n)
    if not pairs:
        return label
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _order(sample: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Three principal axes about the mean, and the sample's quantiles on the first two: they sort vectors so that tiles are compact."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :3], [np.empty(0), np.empty(0)]
    found = axes(sample - sample.mean(axis=0))[:, :3]
    cuts = [np.quantile(sample @ found[:, k], np.arange(1, CELLS) / CELLS) for k in range(min(2, found.shape[1]))]
    return found, cuts


def _tiles(reps: DataFrame, sample: np.ndarray, dtype: str, groups: int) -> DataFrame:
    """Tiles of vectors that lie near each other: group and the packed nodes, copies and vectors."""
    directions, cuts = _order(sample)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                along = unit(np.stack(pdf["embedding"])) @ directions
                cell = np.zeros(len(pdf), np.int64)
                for k, cut in enumerate(cuts):
                    cell = cell * CELLS + np.searchsorted(cut, along[:, k])
                yield pdf.assign(cell=cell, along=along[:, -1])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        start, made = TaskContext.get().partitionId(), 0

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            return pd.DataFrame(
                {
                    "group": [(start + made) % groups], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
                    "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(pdf["embedding"]).astype(dtype).tobytes()],
                }
            )

        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= TILE:
                rows = pd.concat(held)
                yield tile(rows[:TILE])
                held = [rows[TILE:]]
        rows = pd.concat(held) if held else pd.DataFrame()
        if len(rows):
            yield tile(rows)

    n = max(1, math.ceil(reps.count() / (4 * TILE)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    ordered = reps.mapInPandas(project, schema + ", cell long, along double").repartitionByRange(n, "cell", "along").sortWithinPartitions("cell", "along")
    return ordered.mapInPandas(cut, "group int, nodes binary, copies binary, vectors binary")


class Tile:
    """Rotated unit vectors of a tile with their names, copies and bounding box."""

    def __init__(self, row, dim: int, dtype: str, basis: np.ndarray):
        self.nodes, self.copies = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.copies, np.int64)
        self.vectors = unit(np.frombuffer(row.vectors, dtype).reshape(-1, dim)) @ basis
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)

    def apart(self, other: Tile, reach: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(gap @ gap) > reach * reach

    def compared(self, other: Tile, threshold: float) -> pd.DataFrame:
        same = self is other
        shift = 0 if same else len(self.nodes)
        links, pairs = np.zeros(shift + len(other.nodes), np.int64), []
        for i, j in _links(self.vectors, other.vectors, same, threshold):
            np.add.at(links, i, other.copies[j])
            np.add.at(links, j + shift, self.copies[i])
            if len(i):
                pairs.append((i, j + shift))
        root = _forest(len(links), pairs)
        nodes = self.nodes if same else np.concatenate([self.nodes, other.nodes])
        found = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[found], "links": links[found], "root": nodes[root[found]]})


def _compared(reps: DataFrame, dim: int, dtype: str, threshold: float) -> DataFrame:
    """(node, links, root) from all tile pairs of representatives of one length.

    Tiles are dealt into groups, and a task has a pair of groups: it holds the tiles of one and streams those of the other past them. A
    tile travels once for every group, so what is shuffled grows with the rows and the root of the number of tasks. Tiles whose
    boxes are too far apart are not compared.
    """
    spark = reps.sparkSession
    n = reps.count()
    sample = reps.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(min(FIT, (64 << 20) // (8 * dim))).toPandas()
    sample = unit(np.stack(sample["embedding"])) if len(sample) else np.eye(dim)
    basis = axes(sample)
    # As many pairs of groups as give every core two, and more groups where one would not fit into a task's memory.
    groups = max(math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)), math.ceil(n * dim * 8 / GROUP_BYTES))
    groups = max(1, min(groups, math.ceil(n / TILE)))
    tiles = materialize(_tiles(reps, sample, dtype, groups))
    low, high = F.least("group", "__other"), F.greatest("group", "__other")
    pair = low * groups - F.floor(low * (low - 1) / 2) + high - low
    tasks = min(groups * (groups + 1) // 2, 20_000)
    dealt = tiles.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(pair.cast("long").alias("pair"), (F.col("group") != low).alias("second"), "nodes", "copies", "vectors")
    dealt = dealt.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "second")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, alone = None, [], True
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.pair != current:
                    current, held, alone = row.pair, [], row.pair in diagonal
                tile = Tile(row, dim, dtype, basis)
                if not row.second:
                    held.append(tile)
                if row.second or alone:
                    for other in held:
                        if other is tile or not other.apart(tile, reach):
                            yield other.compared(tile, threshold)

    # Pairs of a group with itself, whose tiles meet each other.
    diagonal = {g * groups - g * (g - 1) // 2 for g in range(groups)}
    return materialize(dealt.mapInPandas(compare, "node long, links long, root long"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    rows = embeddings.select("vec_id", "embedding", F.when(is_vector(), F.xxhash64("embedding")).alias("node"))
    reps = materialize(
        rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    dtype = "float64" if "double" in embeddings.schema["embedding"].dataType.simpleString() else "float32"
    found = None
    for (dim,) in reps.select(F.size("embedding")).distinct().collect():
        part = _compared(reps.where(F.size("embedding") == dim).select("node", "copies", "embedding"), dim, dtype, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "node long, links long, root long")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = reps.drop("embedding").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answers = named.join(smallest, "component").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.drop("embedding").join(answers, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      and list_cosine_similarity(a.e, b.e) >= 0.95),
n as (select x, count(*)::bigint as n_links from p group by 1),
r as (select x, y from p union select r.x, p.y from r join p on p.x = r.y),
c as (select x, min(y) as y from r group by 1)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, least(e.vec_id, coalesce(c.y, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(c.y, e.vec_id)) as kept
from embeddings e left join n on n.x = e.vec_id left join c on c.x = e.vec_id
"""
