"""Language-model scores by interpolated modified Kneser-Ney, counted in Spark and looked up in memory-mapped hash arrays.

Counting: a task hashes the words of whole texts and adds up the n-grams of each order within a few million tokens. They go on as
sorted, packed pieces, dealt to shards by ranges of their ids; a shard's task merges its pieces and writes one sorted array
of ids with counts into the shared folder. An order's task also sends, to the order below, how many different words stand before each n-gram's
suffix (its continuation count) and what follows each prefix (the total and the numbers of words seen once, twice and more often).

The id of an n-gram starts with bits of its prefix, so an order is sorted by prefix, and the bounds between shards are
quantiles of a sample of n-grams: a prefix with a third of all n-grams is spread over many shards. The sample only sets where shards end; the
number of shards grows with the corpus, so a shard stays small, and nothing but bounds and counts of counts reaches the driver.

The model: counts of the highest order are occurrences, those below are continuation counts (occurrences where nothing stands before, after
the begin mark); discounts come from counts of counts, and the lowest order is interpolated with 1 / (V + 1), the share of an unknown word.

Scoring: workers map the arrays into memory, so one copy serves all workers of a machine and no worker holds a model, and look up the distinct ids
of a batch in order. If the shared folder is a store that cannot be mapped, a shard at a time is read from it.

ORDER is 2: the different three-word runs of check_s, 0.1 GB, alone take 1.8 times the input as hash arrays and as much again on their way there. The
functions take any order; tests hold 1, 2 and 3 against dictionaries.

Cases: null and empty texts are the end alone; repeated rows are texts of their own; a null doc_id has the remainder of none and is trained on; with
nothing to train on every token has probability 1. Letters are lower-cased A-Z only. Further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import materialize, mix64, raw_word_hashes, shared_dir, small_batches

ORDER = 2
#: Tokens that a task holds at once while it counts and while it scores, entries that a shard is to have, and texts whose n-grams set the bounds.
HELD, SCORED = 1 << 20, 1 << 18
SHARD = 1 << 20
SAMPLE = 2000
#: Bits of an id that come from its prefix, so that n-grams of one prefix lie together.
HEAD = 20
END, BEGIN = np.uint64(0x5D1C9A6F3B2E8847), np.uint64(0xA3C59AC2F1036E15)
FOLDS, HELD_OUT = 5, 1

#: What is known of an id: raw and adjusted count, what follows it as a context, and how many words stand before it.
STATS = ("raw", "before", "total", "ones", "twos", "more")


def joined_ids(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Ids of n-grams from those of their first and last n - 1 words."""
    tail = mix64(prefix * np.uint64(0x9E3779B97F4A7C15) + suffix)
    return (prefix >> np.uint64(64 - HEAD) << np.uint64(64 - HEAD)) | (tail >> np.uint64(HEAD))


class Tokens:
    """Ids of the words of some texts and of all n-grams that end in each."""

    def __init__(self, texts: list[str | None]) -> None:
        words = [raw_word_hashes((t or "").encode("utf-8", "surrogatepass").lower()) for t in texts]
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(self.sizes)
        self.ids = np.full(ends[-1] if len(ends) else 0, END, np.uint64)
        inside = np.ones(len(self.ids), bool)
        inside[ends - 1] = False
        self.ids[inside] = np.concatenate(words) if words else self.ids
        self.starts = ends - self.sizes
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts, self.sizes)

    def orders(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order k >= 2: which tokens end an n-gram of it, and the ids of its prefix and suffix. The first may be the begin mark."""
        before, here, start = np.concatenate([[BEGIN], self.ids[:-1]]) if len(self.ids) else self.ids, self.ids, 0
        before = np.where(self.place == 0, BEGIN, before)
        for _ in range(2, order + 1):
            at = np.flatnonzero(self.place >= start)
            yield at, before[at], here[at]
            full = joined_ids(before, here)
            before, here, start = np.concatenate([[np.uint64(0)], full[:-1]]) if len(full) else full, full, start + 1


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where runs of equal ids start in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)


def merged(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ids in order, with sums of their values."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = _runs(ids)
    return ids[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


PIECE = pa.schema([("rank", pa.int32()), ("shard", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
PIECE_SQL = "rank int, shard int, kind string, data binary"


def _pieces(rank: int, kind: str, bounds: np.ndarray, ids: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One packed piece a shard: its part of the columns, which are in order of the ids."""
    cuts = np.concatenate([[0], np.searchsorted(ids, bounds), [len(ids)]])
    for shard in np.flatnonzero(cuts[1:] > cuts[:-1]):
        low, high = cuts[shard], cuts[shard + 1]
        data = b"".join(c[low:high].tobytes() for c in columns)
        yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([shard], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], schema=PIECE)


def _unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: Prefix, suffix and number of n-grams, whose ids follow from these.
GRAM_KINDS = ["<u8", "<u8", "<u4"]
#: Kinds of pieces about single ids, and which statistics each carries.
ABOUT = {"raw": ("raw",), "before": ("before",), "after": ("total", "ones", "twos", "more")}


def _texts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int) -> Iterator[list[list]]:
    """Rows of the columns, the text last, gathered until they hold about so many tokens."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            for values, v in zip(held, row, strict=True):
                values.append(v)
            size += len(row[-1] or "") + 6
            if size >= 6 * most:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _sampled_bounds(docs: DataFrame, order: int) -> list[np.ndarray]:
    """For each order, the ids at which its shards but the first start: quantiles of a sample of SAMPLE texts, in numbers that grow with the corpus."""
    rows = docs.count()

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        tokens = Tokens(texts)
        shards = max(1, math.ceil(len(tokens.ids) * rows / max(1, len(texts)) / SHARD))
        for rank in range(1, order + 1):
            ids = tokens.ids if rank == 1 else joined_ids(*list(tokens.orders(order))[rank - 2][1:])
            ids = np.unique(ids)
            # Words are few next to pairs of them.
            n = min(shards if rank > 1 else max(1, shards // 4), max(1, len(ids)))
            cuts = ids[(np.arange(1, n) * len(ids)) // n] if len(ids) else ids
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([cuts.tobytes()], pa.binary())], ["rank", "cuts"])

    few = docs.select("text") if rows <= SAMPLE else docs.select("text").sample(SAMPLE / rows, seed=11)
    found = few.repartition(1).mapInArrow(quantiles, "rank int, cuts binary").collect()
    cuts = {r["rank"]: np.frombuffer(r["cuts"], "<u8") for r in found}
    return [np.unique(cuts.get(k, np.empty(0, "<u8"))) for k in range(1, order + 1)]


def _counted(docs: DataFrame, order: int, bounds: list[np.ndarray]) -> DataFrame:
    """Pieces with the n-grams of every order within each task's tokens, and their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in _texts(batches, ("text",), HELD):
            tokens = Tokens(texts)
            ids, n = merged(tokens.ids, np.ones(len(tokens.ids), np.int64))
            yield from _pieces(1, "raw", bounds[0], ids, [ids, n])
            for rank, (_, prefix, suffix) in enumerate(tokens.orders(order), 2):
                full = joined_ids(prefix, suffix)
                by_id = np.argsort(full, kind="stable")
                full = full[by_id]
                at = _runs(full)
                n = np.diff(np.append(at, len(full))).astype("<u4")
                first = by_id[at]
                yield from _pieces(rank, "grams", bounds[rank - 1], full[at], [prefix[first], suffix[first], n])

    return docs.select("text").mapInArrow(count, PIECE_SQL)


ARRAY_SQL = PIECE_SQL + ", file string, low decimal(20,0), entries long, counts array<long>"


def _merge_order(pieces: DataFrame, rank: int, order: int, bounds: list[np.ndarray], folder: str) -> DataFrame:
    """Merge the pieces of one order into array files; rows of the files, and pieces for the orders below.

    Pieces of lower orders pass through, so that texts are read once for all orders.
    """
    shards = len(bounds[rank - 1]) + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        shard = None
        for batch in batches:
            lower = batch.filter(pa.compute.less(batch.column("rank"), rank))
            if lower.num_rows:
                yield _widened(lower)
            for r in batch.filter(pa.compute.equal(batch.column("rank"), rank)).to_pylist():
                shard = r["shard"]
                held.setdefault(r["kind"], []).append(r["data"])
        if shard is not None:
            yield from _written(held, rank, order, bounds, folder, shard)

    # A task for each shard of this order; the numbers of lower orders' shards don't matter here.
    return pieces.repartitionById(shards, F.pmod("shard", F.lit(shards))).mapInArrow(write, ARRAY_SQL)


ARRAY = pa.schema([*PIECE, ("file", pa.string()), ("low", pa.decimal128(20, 0)), ("entries", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _widened(piece: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*piece.columns, *(pa.nulls(piece.num_rows, f.type) for f in list(ARRAY)[4:])], schema=ARRAY)


def _written(held: dict[str, list[bytes]], rank: int, order: int, bounds: list[np.ndarray], folder: str, shard: int) -> Iterator[pa.RecordBatch]:
    ids, stats = np.empty(0, "<u8"), {s: np.empty(0, np.int64) for s in STATS}
    prefix = suffix = None
    if "grams" in held:
        parts = [_unpacked(d, GRAM_KINDS) for d in held.pop("grams")]
        prefix, suffix, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        every = joined_ids(prefix, suffix)
        by_id = np.argsort(every, kind="stable")
        at = _runs(every[by_id])
        n = np.add.reduceat(n[by_id].astype(np.int64), at)
        by_id = by_id[at]
        ids, prefix, suffix = every[by_id], prefix[by_id], suffix[by_id]
        none = np.zeros(len(ids), np.int64)
        stats = dict.fromkeys(STATS, none) | {"raw": n}
    if held:  # what is known of single ids, from the order above
        all_ids, columns = [ids], {s: [stats[s]] for s in STATS}
        for kind, blobs in held.items():
            for blob in blobs:
                own, *values = _unpacked(blob, ["<u8"] + ["<i8"] * len(ABOUT[kind]))
                all_ids.append(own)
                for s in STATS:
                    columns[s].append(values[ABOUT[kind].index(s)] if s in ABOUT[kind] else np.zeros(len(own), np.int64))
        found = merged(np.concatenate(all_ids), *(np.concatenate(columns[s]) for s in STATS))
        if prefix is not None:  # contexts of the order above are n-grams of this one, or their ids would be unknown
            place = np.searchsorted(found[0], ids)
            wide = lambda c: (np.zeros(len(found[0]), "<u8"), c)
            (p, own_p), (s, own_s) = wide(prefix), wide(suffix)
            p[place], s[place] = own_p, own_s
            prefix, suffix = p, s
        ids, stats = found[0], dict(zip(STATS, found[1:], strict=True))
    # The highest order and n-grams after the begin mark count occurrences, the others what stands before them.
    adjusted = stats["raw"] if rank == order else np.where(stats["before"] > 0, stats["before"], stats["raw"])
    if rank == 1:
        adjusted = stats["before"] if order > 1 else stats["raw"]
    if prefix is not None:
        p, total, *numbers = merged(prefix, adjusted, *(adjusted == k for k in (1, 2)), adjusted > 2)
        below = [_pieces(rank - 1, "after", bounds[rank - 2], p, [p, *(c.astype("<i8") for c in (total, *numbers))])]
        s, n = merged(suffix, np.ones(len(suffix), np.int64))
        below.append(_pieces(rank - 1, "before", bounds[rank - 2], s, [s, n.astype("<i8")]))
        for pieces in below:
            for piece in pieces:
                yield _widened(piece)
    # ids, adjusted counts; below the highest order also what follows the id, and at the lowest raw counts.
    kept = [ids.astype("<u8"), adjusted.astype("<f4")]
    if rank < order:
        kept += [stats["total"].astype("<i8"), *(stats[s].astype("<f4") for s in ("ones", "twos", "more"))]
    if rank == 1:
        kept.append(stats["raw"].astype("<i8"))
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    name = f"order-{rank}-shard-{shard}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{name}") as out:
        for column in kept:
            out.write(column.tobytes())
    of_counts = [int((adjusted == k).sum()) for k in (1, 2, 3, 4)]
    sums = [int(adjusted.sum()), int((adjusted > 0).sum()), int(stats["raw"].sum()), int((stats["raw"] > 0).sum())]
    low = Decimal(int(ids[0]) if len(ids) else 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([rank], pa.int32()), pa.array([shard], pa.int32()), pa.array(["file"]), pa.nulls(1, pa.binary()), pa.array([name]), pa.array([low], pa.decimal128(20, 0)), pa.array([len(ids)], pa.int64()), pa.array([of_counts + sums], pa.list_(pa.int64()))], schema=ARRAY
    )


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return pyarrow.fs.FileSystem.from_uri(uri)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's D1, D2 and D3+; 0.5, 1 and 1.5 where the counts of counts don't give them."""
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 <= d <= k else k / 2 for k, d in enumerate(found, 1))


@dataclass
class Table:
    """One order's arrays: files in order of ids, with the first id of each."""

    folder: str
    kinds: list[str]
    files: list[tuple[str, int]] = field(default_factory=list)
    lows: np.ndarray | None = None

    def _columns(self, name: str, n: int) -> list[np.ndarray]:
        fs, root = _open(self.folder)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            whole = np.memmap(f"{root}/{name}", np.uint8, "r")
        else:
            with fs.open_input_stream(f"{root}/{name}") as stream:
                whole = np.frombuffer(stream.read(), np.uint8)
        out, at = [], 0
        for k in self.kinds:
            size = n * np.dtype(k).itemsize
            out.append(whole[at : at + size].view(k))
            at += size
        return out

    def find(self, ids: np.ndarray) -> list[np.ndarray]:
        """The values of sorted distinct ids, zeros for those that aren't there."""
        out = [np.zeros(len(ids), k) for k in self.kinds[1:]]
        if not len(self.files) or not len(ids):
            return out
        cuts = np.concatenate([[0], np.searchsorted(ids, self.lows[1:]), [len(ids)]])
        for f in np.flatnonzero(cuts[1:] > cuts[:-1]):
            name, n = self.files[f]
            low, high = cuts[f], cuts[f + 1]
            keys, *values = self._columns(name, n)
            at = np.minimum(np.searchsorted(keys, ids[low:high]), n - 1)
            hit = np.flatnonzero(keys[at] == ids[low:high])
            for column, value in zip(out, values, strict=True):
                column[low + hit] = value[at[hit]]
        return out


@dataclass
class Model:
    order: int
    tables: list[Table]
    discounts: list[tuple[float, float, float]]
    #: Sum of the lowest order's counts, and its numbers of words by discount.
    lowest: tuple[int, tuple[int, int, int]]
    words: int
    tokens: int

    def weight(self, rank: int, total, ones, twos, more) -> np.ndarray:
        """Probability that contexts leave to the order below; 1 where nothing is known of them."""
        d = self.discounts[rank - 1]
        known = np.maximum(total, 1)
        return np.where(total > 0, (d[0] * ones + d[1] * twos + d[2] * more) / known, 1.0)

    def share(self, rank: int, counts: np.ndarray, total) -> np.ndarray:
        counts = counts.astype(float)
        d = np.array([0.0, *self.discounts[rank - 1]])[np.minimum(counts, 3).astype(np.int64)]
        return np.where(total > 0, (counts - d) / np.maximum(total, 1), 0.0)

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        tokens = Tokens(texts)
        distinct, back = np.unique(tokens.ids, return_inverse=True)
        if self.order > 1:
            with_begin = np.unique(np.append(distinct, BEGIN))
            found = self.tables[0].find(with_begin)
            about = np.searchsorted(with_begin, distinct)
            adjusted, raw = found[0][about], found[-1][about]
        else:
            adjusted, raw = self.tables[0].find(distinct)
        total, (ones, twos, more) = self.lowest
        lowest = self.share(1, adjusted, total) + self.weight(1, np.int64(total), ones, twos, more) / (self.words + 1)
        p = lowest[back]
        context_ids, context = (with_begin, found) if self.order > 1 else (None, None)
        for rank, (at, prefix, suffix) in enumerate(tokens.orders(self.order), 2):
            grams, own = np.unique(joined_ids(prefix, suffix), return_inverse=True)
            values = self.tables[rank - 1].find(grams)
            place = np.minimum(np.searchsorted(context_ids, prefix), len(context_ids) - 1)
            known = context_ids[place] == prefix
            total, ones, twos, more = (np.where(known, c[place], 0) for c in context[1:5])
            p[at] = self.share(rank, values[0][own], total) + self.weight(rank, total, ones, twos, more) * p[at]
            context_ids, context = grams, values
        base = np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.words + 1)))[back]
        add = lambda c: np.add.reduceat(c, tokens.starts) if len(tokens.starts) else c[:0]
        return [tokens.sizes, add((raw > 0)[back].astype(np.int64)), add(base), add(np.log10(p))]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all rows of docs (text), its arrays in the shared folder."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    bounds = _sampled_bounds(docs, order)
    tables, every_discount, lowest, words, tokens = [], [], (0, (0, 0, 0)), 0, 0
    with small_batches(spark, 16):
        pieces = _counted(docs, order, bounds)
        for rank in range(order, 0, -1):
            written = materialize(_merge_order(pieces, rank, order, bounds, folder))
            files = sorted(written.where("kind = 'file'").select("file", "low", "entries", "counts").collect(), key=lambda r: int(r["low"]))
            files = [r for r in files if r["entries"]]
            kinds = ["<u8", "<f4"] + (["<i8", "<f4", "<f4", "<f4"] if rank < order else []) + (["<i8"] if rank == 1 else [])
            tables.append(Table(folder, kinds, [(r["file"], r["entries"]) for r in files], np.array([int(r["low"]) for r in files], np.uint64)))
            counts = [sum(r["counts"][i] for r in files) for i in range(8)]
            every_discount.append(discounts(*counts[:4]))
            if rank == 1:
                lowest = (counts[4], (counts[0], counts[1], counts[5] - counts[0] - counts[1]))
                tokens, words = counts[6], counts[7]
            else:
                pieces = written.where("kind <> 'file'").select("rank", "shard", "kind", "data")
    return Model(order, tables[::-1], every_discount[::-1], lowest, words, tokens)


def score(docs: DataFrame, model: Model, columns: str = "doc_id long") -> DataFrame:
    """n_tokens, n_known, base_score and score of all rows of docs, with one further column of theirs."""
    name = columns.split()[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches, (name, "text"), SCORED):
            n, known, base, own = model.score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n), pa.array(known), pa.array(base), pa.array(own)], [name, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(name, "text").mapInArrow(scored, f"{columns}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    with small_batches(spark, 500):
        scored = materialize(score(docs, model))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
