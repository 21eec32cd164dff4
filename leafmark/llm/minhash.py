"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed five-word shingles are counted over all documents, in a table of fixed
   size. A shingle weighs tf * log2(1 + 1 / (df / N + DAMPING)): what a notable share of the corpus
   contains (boilerplate) weighs little, and the weights depend on shares, so they are alike at any size.
2. Improved consistent weighted sampling draws, for each of 64 hash functions, one shingle and level from a
   weighted set; two documents agree on a draw with the probability of their weighted Jaccard similarity.
3. Four draws make a band; documents that agree on one of 16 bands share a bucket. At a similarity of 0.8
   a pair shares no bucket with probability 2e-4.
4. Verification by weighted Jaccard similarity of the whole texts' shingles. First every member of a
   bucket is compared with one centre, the text that is in the largest buckets. Then, in buckets that still
   hold more than one component, members of the largest one are compared with the others and these
   with each other, in blocks, by all of their shingles unless their sizes alone rule it out. Blocks yield spanning forests, so no pairs
   are ever listed and no link between components is lost.
5. Links become components; a class is named after its smallest doc_id.

Documents with the same text are one node throughout: sketches, buckets and links know texts, not rows.

Cases: words are runs of non-blank characters, lower-cased; a text of one to four words is one shingle; a
text without words (null or empty) links with nothing but equal rows' texts: null with null, empty with
empty are not linked, each such row is a class of its own. Null doc_ids count as larger than any other; the class
of documents without any id has a null class_id. One text of a class is kept: of those with its smallest doc_id the one whose hash is
smallest, so that texts that share a doc_id don't all stay. Rows that repeat a doc_id and text are one document. Two
texts whose 64-bit hashes collide would be taken as copies. Further columns pass through keep_one(), those of one row where rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import (
    Scratch,
    connected_components,
    materialize,
    mix64,
    ngram_hashes,
    sifted,
    small_batches,
    word_hashes,
)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
DRAWS = BANDS * ROWS
#: Buckets of the frequency table, and how many of them travel in one row.
TABLE, SLICE = 1 << 19, 1 << 13
#: Added to a shingle's share of the documents. Weights then lie between 0.585 and 1: where one text has near copies in a third of all rows,
#: what they share must not count for less than the few words in which they differ.
DAMPING = 1.0
#: Weights are rounded to powers of exp(STEP).
STEP = 0.125
#: Random variables of a draw are read from this many cells by a hash of the shingle.
CELLS = 1 << 12
BLOCK = 512
#: Shingles compared at a time in a block.
STRIP = 8192


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text, in order, and how often each occurs."""
    words = word_hashes(text)
    return np.unique(ngram_hashes(words, min(n, len(words))) if len(words) else words, return_counts=True)


class Sampler:
    """Consistent weighted draws for one frequency table."""

    def __init__(self, idf: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.idf = idf
        self.multipliers = rng.integers(1, 1 << 63, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, (DRAWS, CELLS))
        self.log_c = np.log(rng.gamma(2, 1, (DRAWS, CELLS)))
        self.beta = rng.random((DRAWS, CELLS))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def levels(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and the rounded logarithms of their TF-IDF weights."""
        found, tf = shingles(text)
        weights = tf * self.idf[(found & np.uint64(TABLE - 1)).astype(np.int64)]
        return found, np.rint(np.log(weights) / STEP).astype(np.int64)

    def _table(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """log a and t of every draw and cell for one weight."""
        if level not in self.tables:
            t = np.floor(level * STEP / self.r + self.beta)
            self.tables[level] = (self.log_c - self.r * (t - self.beta + 1)).astype(np.float32).ravel(), t.astype(np.int32).ravel()
        return self.tables[level]

    def draw(self, text: str | None) -> np.ndarray | None:
        """One 64-bit name of the drawn shingle and level for each draw; None without words."""
        found, levels = self.levels(text)
        if not len(found):
            return None
        rows = np.arange(DRAWS, dtype=np.uint64)[:, None] * np.uint64(CELLS)
        each = np.arange(DRAWS)
        least, names = np.full(DRAWS, np.inf, np.float32), np.zeros(DRAWS, np.uint64)
        for level in np.unique(levels):
            log_a, t = self._table(int(level))
            own = found[levels == level]
            for start in range(0, len(own), 1 << 14):
                part = own[start : start + (1 << 14)]
                cells = ((part[None, :] * self.multipliers[:, None]) >> np.uint64(52)) + rows
                values = log_a.take(cells.view(np.int64))
                best = values.argmin(axis=1)
                value = values[each, best]
                better = value < least
                at = cells[each, best].astype(np.int64)
                name = mix64(part[best] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                least, names = np.where(better, value, least), np.where(better, name, names)
        return names


def features(text: str | None) -> np.ndarray:
    """A text's weighted shingles as a set: the k-th occurrence of a shingle is an element of its own.

    The low bits of an element are its shingle's bucket in the frequency table, which gives its weight; the weight of the
    intersection of two such sets is the sum of the lesser weights of their shingles.
    """
    found, tf = shingles(text)
    each = np.repeat(found, tf)
    nth = (np.arange(len(each)) - np.repeat(np.cumsum(tf) - tf, tf)).astype(np.uint64)
    mixed = mix64(each + nth * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(TABLE - 1)
    return np.sort((mixed & ~low) | (each & low))


def weight(elements: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(elements & np.uint64(TABLE - 1)).astype(np.int64)]


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two feature sets."""
    shared = weight(np.intersect1d(a, b, assume_unique=True), idf).sum()
    return float(shared / (weight(a, idf).sum() + weight(b, idf).sum() - shared)) if shared else 0.0


def node(text: str = "text") -> Column:
    """Names a text; documents with equal texts are one node."""
    return F.xxhash64(F.lit(9), F.col(text))


def has_words(text: str = "text") -> Column:
    return F.col(text).rlike(r"\S")


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight of each bucket from its document frequency over all documents: TABLE numbers, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TABLE, np.int32), 0
        for pdf in batches:
            for text in pdf["text"]:
                found, _ = shingles(text)
                n += len(found) > 0
                df[np.unique((found & np.uint64(TABLE - 1)).astype(np.int64))] += 1
        yield pd.DataFrame({"part": range(TABLE // SLICE), "df": [df[i : i + SLICE].tobytes() for i in range(0, TABLE, SLICE)], "n": n})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for part, raw, n in zip(pdf["part"], pdf["df"], pdf["n"], strict=True):
                df, m = totals.get(part, (np.zeros(SLICE, np.int64), 0))
                totals[part] = df + np.frombuffer(raw, np.int32), m + n
        for part, (df, n) in totals.items():
            yield pd.DataFrame({"part": [part], "df": [df.tobytes()], "n": [n]})

    schema = "part int, df binary, n long"
    # One row per task and slice meets those of the other tasks; sums are taken as they stream by.
    parts = docs.select("text").mapInPandas(count, schema).repartition(TABLE // SLICE, "part").mapInPandas(fold, schema)
    df, n = np.zeros(TABLE), 1
    for row in parts.toLocalIterator():
        df[row["part"] * SLICE : (row["part"] + 1) * SLICE] = np.frombuffer(row["df"], np.int64)
        n = max(1, row["n"])
    return np.log2(1 + 1 / (df / n + DAMPING))


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, bands, draws) for every distinct text with words."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(table.value)
        for pdf in batches:
            drawn = [sampler.draw(text) for text in pdf["text"]]
            bands = []
            for names in drawn:
                rows = names.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
                bands.append(key.view(np.int64))
            yield pd.DataFrame({"node": pdf["node"], "bands": bands, "draws": [x.astype(np.uint32).tobytes() for x in drawn]})

    texts = docs.where(has_words()).select(node().alias("node"), "text")
    return texts.mapInPandas(sketch, "node long, bands array<long>, draws binary").dropDuplicates(["node"])


def feature_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, features, n) of the wanted nodes' texts."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(text) for text in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "features": [x.tobytes() for x in found], "n": [len(x) for x in found]})

    rows = docs.where(has_words()).select(node().alias("node"), "text")
    # Only texts that pass the sieve are shuffled to meet the wanted nodes.
    texts = sifted(rows, F.col("node"), wanted.select("node")).where("__may").drop("__may").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return texts.mapInPandas(take, "node long, features binary, n long")


def verified(pairs: DataFrame, table: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Of (a, b) pairs of nodes, those that are at least so similar, as (src, dst).

    The b of one a are cut into blocks of bounded members and features, so an a that a third of all texts is compared with is
    a key of as many rows as it has blocks, and its features travel once a block.
    """
    weights = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, left, rows in zip(pdf["a"], pdf["left"], pdf["rows"], strict=True):
                own = np.frombuffer(left, np.uint64)
                near = [r["b"] for r in rows if similarity(own, np.frombuffer(r["features"], np.uint64), weights.value) >= threshold]
                if near:
                    yield pd.DataFrame({"src": a, "dst": near})

    sized = pairs.join(table.select(F.col("node").alias("b"), "n"), "b")
    blocks = sized.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * 1000))).cast("int").alias("blocks"))
    placed = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b", F.lit(3)), F.col("blocks")).cast("int")).drop("blocks")
    right = placed.join(table.select(F.col("node").alias("b"), "features"), "b").groupBy("a", "block").agg(F.collect_list(F.struct("b", "features")).alias("rows"))
    # A row of the left for every block, so that blocks stay where they have been gathered.
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = blocks.select("a", each).join(table.select(F.col("node").alias("a"), F.col("features").alias("left")), "a")
    both = right.join(left, ["a", "block"])
    return both.select("a", "left", "rows").mapInPandas(compare, "src long, dst long")


def _block_links(a: list[np.ndarray], b: list[np.ndarray], asked: np.ndarray, idf: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the asked pairs of two blocks of feature sets are similar enough.

    Few pairs are compared one by one. Many are compared at once: shingles that several sets hold become columns, a strip at a time,
    and products of the two blocks add up the shared weights.
    """
    i, j = np.nonzero(asked)
    out = np.zeros(asked.shape, bool)
    if len(i) <= 64:
        for x, y in zip(i, j, strict=True):
            out[x, y] = similarity(a[x], b[y], idf) >= threshold
        return out
    rows, cols = np.unique(i), np.unique(j)
    sets = [a[x] for x in rows] + [b[y] for y in cols]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    elements, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    shared = np.zeros((len(rows), len(cols)))
    place = np.full(len(elements), -1)
    for start in range(0, len(several), STRIP):
        strip = several[start : start + STRIP]
        place[:] = -1
        place[strip] = np.arange(len(strip))
        inside = place[column] >= 0
        grid = np.zeros((len(sets), len(strip)), np.float32)
        grid[owner[inside], place[column[inside]]] = 1
        shared += (grid[: len(rows)] * weight(elements[strip], idf).astype(np.float32)) @ grid[len(rows) :].T
    total = np.array([weight(x, idf).sum() for x in sets])
    union = total[: len(rows), None] + total[None, len(rows) :] - shared
    x, y = np.searchsorted(rows, i), np.searchsorted(cols, j)
    # Products are in single precision: what is within their error of the threshold is compared exactly.
    value = shared[x, y] / union[x, y]
    for k in np.flatnonzero(np.abs(value - threshold) < 1e-4):
        value[k] = similarity(a[i[k]], b[j[k]], idf)
    out[i, j] = value >= threshold
    return out


def open_links(members: DataFrame, drawn: DataFrame, table: DataFrame, idf: np.ndarray, threshold: float, scratch: Scratch) -> DataFrame:
    """(src, dst) joining components that share a bucket, from all pairs of their members there.

    members: (node, band, bucket, component). In a bucket the members of the largest component are compared with the others', and these with each
    other; members of one component are not. Both kinds are cut into blocks of bounded members and features, so neither a
    task nor a row holds a whole bucket; the list of block pairs carries no features, and blocks are joined to it by their own numbers, so a
    large bucket is no hot key. A pair is looked at in its first common bucket only, and sizes that rule it out are looked at before its
    shingles. Blocks give spanning forests of their links, never pairs.
    """
    weights = members.sparkSession.sparkContext.broadcast(idf)
    key = ["band", "bucket"]
    counted = members.groupBy(*key, "component").agg(F.count("*").alias("__c"))
    main = counted.groupBy(*key).agg(F.max_by("component", F.struct("__c", "component")).alias("main"), F.count("*").alias("__k")).where("__k > 1").drop("__k")
    open_members = scratch.keep(
        members.select("node", *key, "component").join(main, key).withColumn("minor", F.col("component") != F.col("main")).drop("main").join(table.select("node", "n"), "node")
    )
    sizes = open_members.groupBy(*key, "minor").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * 1000))).cast("int").alias("blocks"))
    placed = open_members.drop("n").join(sizes, [*key, "minor"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    blocks = scratch.keep(
        placed.join(drawn, "node").join(table.select("node", "features"), "node").groupBy(*key, "minor", "block").agg(F.collect_list(F.struct("node", "component", "draws", "features")).alias("rows"))
    )
    names = blocks.select(*key, "minor", "block")
    left = names.where("minor").select(*key, F.col("block").alias("x"))
    right = names.select(*key, F.col("minor").alias("small"), F.col("block").alias("y"))
    pairs = left.join(right, key).where("not small or x <= y")
    payload = lambda at, rows, flag: blocks.select(*key, F.col("minor").alias(flag), F.col("block").alias(at), F.col("rows").alias(rows))
    both = pairs.join(payload("y", "right", "small"), [*key, "small", "y"]).join(payload("x", "left", "minor").where("minor").drop("minor"), [*key, "x"])

    def unpack(rows):
        draws = np.stack([np.frombuffer(r["draws"], np.uint32) for r in rows])
        return np.array([r["node"] for r in rows], np.int64), np.array([r["component"] for r in rows], np.int64), draws, [np.frombuffer(r["features"], np.uint64) for r in rows]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for band, same, left, right in zip(pdf["band"], pdf["small"] & (pdf["x"] == pdf["y"]), pdf["left"], pdf["right"], strict=True):
                a, ca, da, fa = unpack(left)
                b, cb, db, fb = (a, ca, da, fa) if same else unpack(right)
                asked = ca[:, None] != cb[None, :]
                if same:
                    asked = np.triu(asked, 1)
                for k in range(band):
                    shared = np.ones(asked.shape, bool)
                    for d in range(k * ROWS, (k + 1) * ROWS):
                        shared &= da[:, d, None] == db[None, :, d]
                    asked &= ~shared
                # The weight of the lighter text bounds what two share: exact, whatever their draws say.
                ta, tb = (np.array([weight(f, weights.value).sum() for f in fs]) for fs in (fa, fb))
                lighter, heavier = np.minimum(ta[:, None], tb[None, :]), np.maximum(ta[:, None], tb[None, :])
                asked &= lighter >= (threshold - 1e-6) * heavier
                i, j = np.nonzero(_block_links(fa, fb, asked, weights.value, threshold)) if asked.any() else ((), ())
                if not len(i):
                    continue
                # Members of a component are one already: a forest over components is enough.
                names, at = np.unique(np.concatenate([ca, cb]), return_inverse=True)
                src, dst = at[: len(ca)][i], at[len(ca) :][j]
                label = np.arange(len(names))
                while True:
                    least = np.minimum(label[src], label[dst])
                    if (label[src] == least).all() and (label[dst] == least).all():
                        break
                    np.minimum.at(label, src, least)
                    np.minimum.at(label, dst, least)
                    label = label[label]
                moved = np.flatnonzero(label != np.arange(len(names)))
                yield pd.DataFrame({"src": names[moved], "dst": names[label[moved]]})

    return both.select("band", "small", "x", "y", "left", "right").mapInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, class_id, first_id, chosen): class and smallest doc_id of every distinct text with words, and whether it is the one that stays."""
    spark = docs.sparkSession
    scratch = Scratch()
    with small_batches(spark, 500):
        idf = idf_table(docs)
        drawn = scratch.keep(sketches(docs, idf))
    buckets = drawn.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(buckets.join(shared, ["band", "bucket"]))
    # A text close to many others is in their large buckets: it is the centre they are compared with.
    known = members.groupBy("node").agg(F.sum("size").alias("fame"))
    centres = members.join(known, "node").groupBy("band", "bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("a"))
    stars = members.join(centres, ["band", "bucket"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    with small_batches(spark, 500):
        table = scratch.keep(feature_table(docs, known))
    # A row of these holds a block.
    with small_batches(spark, 8):
        links = scratch.keep(verified(stars, table, idf, threshold))
    found = connected_components(links, scratch)
    labelled = members.select("node", "band", "bucket").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A row of these holds two blocks.
    with small_batches(spark, 8):
        more = scratch.keep(open_links(labelled, drawn.select("node", "draws"), table, idf, threshold, scratch))
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), scratch)
    ids = docs.where(has_words()).groupBy(node().alias("node")).agg(F.min("doc_id").alias("first_id"))
    named = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("first_id").isNull(), "first_id", "node")
    classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("node", place).alias("stays"))
    out = materialize(named.join(classes, "component").select("node", "class_id", "first_id", (F.col("node") == F.col("stays")).alias("chosen")))
    scratch.drop(spark)
    return out


def label(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) for every document; kept names the one document of its class that stays."""
    classes = near_duplicates(docs, threshold)
    rows = docs.select("doc_id", F.when(has_words(), node()).alias("node"))
    return rows.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("node").isNull() | (F.col("chosen") & F.col("class_id").eqNullSafe(F.col("doc_id")))).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each class; of rows that repeat its doc_id and text, one stays.

    Only texts of classes with several documents are shuffled, to meet their classes; all others pass a sieve.
    """
    classes = near_duplicates(docs, threshold)
    # A text stays as it is unless it is in a class of other texts or has copies.
    copies = docs.where(has_words()).groupBy(node().alias("node"), "doc_id").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("same_id"))
    several = copies.where("n > 1").select("node", (F.col("same_id") > 1).alias("again"))
    others = classes.where("not chosen").select("node", F.lit(False).alias("again"))
    moved = materialize(others.unionByName(several).groupBy("node").agg(F.max("again").alias("again")))
    rows = sifted(docs.withColumn("__key", F.when(has_words(), node())), F.col("__key"), moved)
    named = classes.join(moved, "node").select(F.col("node").alias("__node"), F.col("class_id").alias("__class"), F.col("chosen").alias("__chosen"), F.col("again").alias("__again"))
    asked = rows.where("__may").join(named.hint("shuffle_hash"), F.col("__key") == F.col("__node"), "left")
    stay = asked.where(F.col("__node").isNull() | (F.col("__chosen") & F.col("__class").eqNullSafe(F.col("doc_id")) & ~F.col("__again")))
    kept = rows.where("not __may").select(*docs.columns).unionByName(stay.select(*docs.columns))
    if moved.where("again").isEmpty():
        return kept
    repeated = named.where("__again and __chosen").drop("__again", "__chosen")
    met = sifted(docs.where(has_words()).withColumn("__key", node()), F.col("__key"), repeated.select("__node")).where("__may")
    first = met.join(repeated.hint("shuffle_hash"), (F.col("__key") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__class"))).dropDuplicates(["__node", "doc_id"])
    return kept.unionByName(first.select(*docs.columns))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark.read.parquet(f"{sf_dir}/documents.parquet"))
