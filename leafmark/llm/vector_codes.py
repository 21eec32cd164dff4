"""Compression of vectors into short codes: product quantization with Drake-Hamerly adaptive bounds.

Vectors become integers, floor(256 * x), and are cut into PARTS consecutive parts. Each part position has a codebook of
up to ENTRIES entries; a code is the index of each part's nearest entry. A round assigns all parts and moves the entries to the means.

The first assignment computes all distances and writes, for every part, its b closest other entries with ordered lower bounds on their
distances and one outer bound for all entries beyond. A later one lowers the bounds by how far entries have moved and measures the
distance to the part's own entry: if the outer bound is beyond it, only listed entries whose bounds are not can be
nearer, and these are verified in integers; otherwise all entries are. b follows what is needed: lists are written anew with
as many entries as all but WIDE of a batch's parts had to look at, from an eighth to a quarter of the codebook. Bounds are kept in half
precision, rounded down, so they never rule out a nearest entry; codes are those of an exhaustive integer search.

The state lies in a written table, so a round is one pass over rows, and sums by (part, entry) are all that is gathered: their number does
not depend on the rows. The codebooks have a fixed size and travel with the tasks.

Cases: vectors that are null or hold null or non-finite components are left out. Components beyond +-2**24 count as these. Vectors are as long
as the longest, rounded up to a multiple of PARTS: missing components count as 0. Null vec_ids come last, equal ones go by vector; repeated
rows are coded alike and count each. With fewer vectors than ENTRIES a codebook has as many entries. An empty table gives no rows. A
label's error beyond a long is null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import Scratch, materialize, small_batches

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 24
#: Share of parts that may need more entries than their list will hold.
WIDE = 0.01
#: Rows of an Arrow batch.
BATCH = 4096
#: A place of a list that holds no entry, and slack for rounding of bounds (relative).
NONE, SLACK = 255, 1e-6


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of usable vectors as integers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return embeddings.where(usable).select("vec_id", "label", F.transform("embedding", whole).alias("v"))


def as_parts(column: pa.Array, length: int) -> np.ndarray:
    """Lists of integers as an array (rows, PARTS, length // PARTS) of doubles, zeros where a list ends early."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), length))
    out[np.arange(length) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(column), PARTS, -1)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to all entries, as doubles or, beyond 2**53, as integers."""
    most = 2 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if most * most * max(1, x.shape[1]) < 2**53:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None].astype(np.int64) - entries[:, d].astype(np.int64)) ** 2
    return out


def lowered(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds in half precision, never above what they were."""
    kept = np.clip(bounds * (1 - SLACK), 0, 60000)
    half = kept.astype(np.float16)
    return np.where(half > kept, np.nextafter(half, np.float16(-1)), half)


class Part:
    """All rows' parts at one position: x, their codes, and near (entries), low and outer (bounds)."""

    def __init__(self, x: np.ndarray, entries: np.ndarray) -> None:
        self.x, self.entries = x, entries

    def search(self, rows: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """code, square, near, low, outer of these rows by comparing them with all entries."""
        d = squares(self.x[rows], self.entries)
        code = d.argmin(1)  # the first of equal ones
        best = d[np.arange(len(rows)), code].astype(np.int64)
        away = np.sqrt(d.astype(float))
        away[np.arange(len(rows)), code] = np.inf
        n = min(b, away.shape[1] - 1)
        order = np.argpartition(away, n, axis=1)[:, : n + 1] if n < away.shape[1] - 1 else np.argsort(away, axis=1)
        order = np.take_along_axis(order, np.take_along_axis(away, order, 1).argsort(1), 1)
        low = np.take_along_axis(away, order, 1)
        near = np.full((len(rows), b), NONE, np.uint8)
        bounds = np.full((len(rows), b), np.inf)
        near[:, :n], bounds[:, :n] = order[:, :n], low[:, :n]
        return code, best, near, bounds, low[:, n]

    def verify(self, code, near, low, outer, moved: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the lists of the round before; also how many listed entries each row had to look at."""
        b = near.shape[1]
        low = np.where(near == NONE, np.inf, low - moved[np.minimum(near, len(moved) - 1)])
        outer = outer - moved.max(initial=0)
        own = ((self.x - self.entries[code]).astype(np.int64) ** 2).sum(1)
        reach = np.sqrt(own.astype(float)) * (1 + SLACK)
        code, best = code.copy(), own.copy()
        looked = (low <= reach[:, None]).sum(1)
        scan = np.flatnonzero(outer <= reach)
        in_list = outer > reach
        bounds = np.maximum(low, 0)
        near = near.copy()
        # The own entry takes the place of the one that replaces it.
        for j in range(b):
            rows = np.flatnonzero(in_list & (low[:, j] <= reach))
            if not len(rows):
                continue
            entry = near[rows, j].astype(np.int64)
            d = ((self.x[rows] - self.entries[entry]).astype(np.int64) ** 2).sum(1)
            wins = (d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))
            near[rows, j] = np.where(wins, code[rows], entry)
            bounds[rows, j] = np.sqrt(np.where(wins, best[rows], d).astype(float))
            code[rows], best[rows] = np.where(wins, entry, code[rows]), np.where(wins, d, best[rows])
        order = bounds.argsort(1, kind="stable")
        near, bounds = np.take_along_axis(near, order, 1), np.take_along_axis(bounds, order, 1)
        if len(scan):
            code[scan], best[scan], near[scan], bounds[scan], outer[scan] = self.search(scan, b)
            looked[scan] = b + 1
        return code, best, near, bounds, outer, looked


STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())), ("code", pa.binary()), ("near", pa.binary()), ("bounds", pa.binary()), ("error", pa.int64())])
STATE_SQL = "vec_id long, label string, v array<int>, code binary, near binary, bounds binary, error long"


def assign(rows: DataFrame, codebooks: np.ndarray, moved: np.ndarray | None, *, keep: bool = True) -> DataFrame:
    """rows with the nearest entries under these codebooks (PARTS, entries, width); by the lists that they carry if moved (PARTS, entries) is given.

    keep: the lists for another round are written along.
    """
    n_entries = codebooks.shape[1]
    widest, narrowest = max(1, n_entries // 4), max(1, n_entries // 8)
    length = PARTS * codebooks.shape[2]

    def lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near, low (rows, PARTS, b) and outer (rows, PARTS); shorter lists of other batches are filled up."""
        near, bounds = batch.column("near").to_pylist(), batch.column("bounds").to_pylist()
        b = max(len(x) for x in near) // PARTS
        entries, low, outer = np.full((len(near), PARTS, b), NONE, np.uint8), np.full((len(near), PARTS, b), np.inf), np.empty((len(near), PARTS))
        for own in {len(x) for x in near}:
            at, k = np.flatnonzero([len(x) == own for x in near]), own // PARTS
            entries[at, :, :k] = np.frombuffer(b"".join(near[i] for i in at), np.uint8).reshape(-1, PARTS, k)
            both = np.frombuffer(b"".join(bounds[i] for i in at), np.float16).reshape(-1, PARTS, k + 1).astype(float)
            low[at, :, :k], outer[at] = both[:, :, :k], both[:, :, k]
        return entries, low, outer

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_parts(batch.column("v"), length)
            n = len(x)
            codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            found = []
            if moved is not None:
                entries, low, outer = lists(batch)
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
            for p in range(PARTS):
                part = Part(x[:, p], codebooks[p])
                if moved is None:
                    code, best, *kept = part.search(np.arange(n), widest)
                    looked = np.full(n, widest)
                else:
                    code, best, *kept, looked = part.verify(before[:, p].astype(np.int64), entries[:, p], low[:, p], outer[:, p], moved[p])
                codes[:, p], error = code, error + best
                found.append((*kept, looked))
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())]
            near_out = bounds_out = pa.nulls(n, pa.binary())
            if keep:
                needed = np.sort(np.concatenate([looked for *_, looked in found]))
                b = int(np.clip(needed[int((1 - WIDE) * (len(needed) - 1))], narrowest, widest))
                near, bounds = np.empty((n, PARTS, b), np.uint8), np.empty((n, PARTS, b + 1), np.float16)
                for p, (entries_p, low_p, outer_p, _) in enumerate(found):
                    k = min(b, entries_p.shape[1])
                    near[:, p], bounds[:, p] = NONE, np.float16(60000)
                    near[:, p, :k], bounds[:, p, :k] = entries_p[:, :k], lowered(low_p[:, :k])
                    # What falls off the list is bounded by the outer bound from now on.
                    off = low_p[:, k:].min(1, initial=np.inf)
                    bounds[:, p, b] = lowered(np.minimum(outer_p, off))
                near_out = pa.array([r.tobytes() for r in near], pa.binary())
                bounds_out = pa.array([r.tobytes() for r in bounds], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, near_out, bounds_out, pa.array(error)], schema=STATE)

    return rows.mapInArrow(assigned, STATE_SQL)


def totals(state: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (PARTS, entries) and sums (PARTS, entries, width) of the parts by their codes; a task sends one row a used entry."""
    parts, n_entries, width = codebooks.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = as_parts(batch.column("v"), parts * width)
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=n_entries)
                    for d in range(width):
                        sums[p, :, d] += np.bincount(codes[:, p], x[:, p, d], n_entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        rows = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, ["part", "entry", "n", "sums"])

    partial = state.select("v", "code").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    counts, sums = np.zeros((parts, n_entries), np.int64), np.zeros(codebooks.shape, np.int64)
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(width))).cast("array<long>").alias("sums")).collect():
        counts[r["part"], r["entry"]], sums[r["part"], r["entry"]] = r["n"], r["sums"]
    return counts, sums


def encode(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of all usable vectors, and the codebooks (PARTS, entries, width); entries: at most 128."""
    spark, scratch = embeddings.sparkSession, Scratch()
    kept = scratch.keep(integers(embeddings).withColumn("label", F.col("label").cast("string")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    codebooks = np.zeros((PARTS, len(first), width))
    for i, r in enumerate(first):
        flat = np.zeros(PARTS * width)
        flat[: len(r["v"])] = r["v"]
        codebooks[:, i] = flat.reshape(PARTS, width)
    none = F.lit(None).cast("binary")
    state = kept.select("vec_id", "label", "v", none.alias("code"), none.alias("near"), none.alias("bounds"), F.lit(0).cast("long").alias("error"))
    moved = None
    with small_batches(spark, BATCH):
        for _ in range(rounds if first else 0):
            state = scratch.keep(assign(state, codebooks, moved))
            counts, sums = totals(state, codebooks)
            means = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks.astype(np.int64)).astype(float)
            moved, codebooks = np.sqrt(((means - codebooks) ** 2).sum(2)) * (1 + SLACK), means
        coded = materialize(assign(state, codebooks, moved, keep=False).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")) if first else state.selectExpr("vec_id", "label", "cast(null as string) as code", "error")
    if first:
        scratch.drop(spark)
    return coded, codebooks.astype(np.int64)


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds unrolled: every part against every entry."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as (select rid, part, min({{'d': d, 'e': entry}}) as best from (
  select x.rid, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x))::bigint as d from x join c{r} c on x.part = c.part and x.pos = c.pos group by all) group by all)""")
        if r < ROUNDS:
            steps.append(f"""m{r} as (select x.part, a.best.e as entry, x.pos, floor(sum(x.x) / count(*))::bigint as x from x join a{r} a using (rid, part) group by all),
c{r + 1} as (select c.part, c.entry, c.pos, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on m.part = c.part and m.entry = c.entry and m.pos = c.pos)""")
    return f"""
with kept as (
  select *, row_number() over (order by vec_id nulls last, v) as rid from (
    select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
x as (select rid, i * {PARTS} // len(v) as part, i % (len(v) // {PARTS}) as pos, v[i + 1] as x from (select rid, v, unnest(range(len(v))) as i from kept)),
c0 as (select part, rid - 1 as entry, pos, x from x where rid <= {ENTRIES}),
{", ".join(steps)},
coded as (select rid, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error from a{ROUNDS} group by rid)
select k.vec_id, d.code, d.error, (sum(d.error) over (partition by k.label))::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from c{ROUNDS}) as codebooks_sha256
from kept k join coded d using (rid)
"""


OP12_SQL = _sql()
