"""Mixing sources to target weights by entropy balancing.

Each source shall contribute a target number of words. Among all document rates between 0 and CAP that do, take those of least
relative entropy to one copy each, under one constraint per source, its expected words. The convex dual has one
variable per source, and a document of w words gets the rate min(CAP, exp(beta * w / mean)): an exponential
tilt, the cap being part of the dual. A source that must shrink gives its long documents up first, one that must grow repeats these most; short ones keep
rates near 1. Newton's method solves the dual within a bracket that every iteration narrows; an iteration is one distributed
aggregation of tilted words and second moments over (source, size) cells and one step per source, in columns. Nothing but the
largest remaining error reaches the driver, and a dual that has not converged is an error.

Rates become copies by systematic rounding: within a source entries stand in order of their words, and each
gets the number of whole steps that the running sum of rates passes in its stretch. As words are
monotone there, the words taken differ from the target by less than one largest entry; then one copy of the entry
that fits the rest best is added or taken. No document gets more
than CAP copies. Rates are fixed-point numbers from here on, so reruns agree.

Running sums are taken in two levels, over cells of a source and a narrow band of sizes, each split by a hash as
finely as its rows are many; a source with a third of all rows is spread over all tasks.

Cases: a null or empty text has size 0 and is never taken; a source without words has target 0. Null is a
source, the last one. Null doc_ids are allowed; rows equal in doc_id, source and size are one entry of so many times the words and take
the same number of copies each. The table of sources (one row each, pre-aggregated) is a dimension and is ordered in one task.
Further columns pass through mix(); those named like its results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import Scratch, materialize

CAP = 3
#: Fixed point of rates: copies in units of 2**-20.
UNIT = 1 << 20
#: Entries in one stretch of the running sum, about.
STRETCH = 512
TOLERANCE = 1e-9


def with_size(docs: DataFrame) -> DataFrame:
    """docs with size: words of the text (runs of anything but ASCII white space)."""
    return docs.withColumn("size", F.coalesce(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size) with target: shares of all words by repeating weights in order of source, null last.

    A target stops at cap times its source's size and what exceeds it is reshared by weight, until none is
    above. That fixed point is min(cap * size, level * weight) for one level; sources are ordered by the level at which they
    stop, and prefix sums give the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * cap
    by_level = Window.orderBy((full / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = (
        weighed.withColumn("__stopped", F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__level", (F.col("__total") - F.col("__stopped")) / F.col("__left"))
    )
    # The level is that of the first source which it does not fill.
    level = F.first(F.when(F.col("__level") * F.col("__w") < full, F.col("__level")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return summed.withColumn("__level", level).select("source", "source_size", F.least(full.cast("double"), F.coalesce(F.col("__level") * F.col("__w"), full.cast("double"))).alias("target"))


def _rate(x) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(x, F.lit(50.0))))


def balance(cells: DataFrame, sources: DataFrame, max_iterations: int = 100) -> DataFrame:
    """Newton's method on the dual: sources with beta, null where nothing or CAP copies of everything are to be taken.

    cells: (source, size, n) of entries with words; sources: (source, source_size, source_docs, target). The dual's gradient, words taken less words wanted, grows
    with beta, so the signs met so far bracket the optimum; a step that leaves the bracket is replaced by its middle or, while it is open, a longer step.
    """
    ratio, mean = F.col("target") / F.col("source_size"), F.col("source_size") / F.col("source_docs")
    scratch = Scratch()
    open_ = (F.col("target") > 0) & (ratio < CAP)
    none = F.lit(None).cast("double")
    state = scratch.keep(sources.withColumns({"beta": F.when(open_, F.log(ratio)), "low": none, "high": none, "error": none}))
    for _ in range(max_iterations):
        x = F.col("size") / mean
        r = _rate(F.col("beta") * x)
        moment = F.when(r < CAP, x * x * r).otherwise(0.0)
        sums = (
            cells.withColumnRenamed("source", "__s").join(state.where("beta is not null"), F.col("__s").eqNullSafe(F.col("source")))
            .groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("n") * x * r).alias("__g"), F.sum(F.col("n") * moment).alias("__h"))
        )
        off = F.col("__g") / (ratio * F.col("source_docs")) - 1
        low, high = F.when(off < 0, F.col("beta")).otherwise(F.col("low")), F.when(off > 0, F.col("beta")).otherwise(F.col("high"))
        met = state.join(sums, F.col("source").eqNullSafe(F.col("__s")), "left").withColumns({"error": off, "low": low, "high": high})
        newton = F.col("beta") - F.try_divide(F.col("error") * ratio * F.col("source_docs"), F.col("__h"))
        longer = F.col("beta") - F.signum("error") * (1 + F.abs("beta"))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("beta")) <= 1 + F.abs("beta"))
        other = F.coalesce((F.col("low") + F.col("high")) / 2, longer)
        step = F.when(F.abs("error") < TOLERANCE, F.col("beta")).when(inside, newton).otherwise(other)
        state = scratch.keep(met.withColumn("beta", step).select(*state.columns))
        worst = state.agg(F.max(F.abs("error"))).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual has not converged after {max_iterations} iterations: a source's words are off by {worst:.2e} of its target")
    done = materialize(state.drop("low", "high", "error"))
    scratch.drop(cells.sparkSession)
    return done


def copies(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """entries (doc_id, source, size, times) with source_size, target and copies, which each of an entry's rows takes."""
    cells = materialize(entries.where("size > 0").groupBy("source", "size").agg(F.sum("times").alias("n")))
    state = balance(cells, sources)
    mean = F.try_divide("source_size", "source_docs")
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("beta").isNull(), float(CAP)).otherwise(_rate(F.col("beta") * F.col("size") / mean))
    dimension = state.withColumnRenamed("source", "__s")
    # Bands of words one twentieth wide, most first; each split so that a stretch stays small.
    words = F.col("size") * F.col("times")
    band = F.when(words == 0, -1).otherwise(F.floor(F.log(words.cast("double")) / F.log(F.lit(1.05))))
    rated = materialize(
        entries.join(dimension, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "size", "times", "source_size", "target", F.round(rate * UNIT).cast("long").alias("rate"), band.alias("band"))
    )
    bands = rated.groupBy(F.col("source").alias("__s"), F.col("band").alias("__b")).agg(F.floor(F.count("*") / STRETCH + 1).alias("__splits"))
    rated = (
        rated.join(bands, F.col("source").eqNullSafe(F.col("__s")) & (F.col("band") == F.col("__b")))
        .withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("__splits")))
        .drop("__s", "__b", "__splits")
    )
    stretches = rated.groupBy("source", "band", "part").agg(F.sum("rate").alias("__sum"))
    offset = F.sum("__sum").over(Window.partitionBy("source").orderBy(F.desc("band"), "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stretches.select(F.col("source").alias("__s"), F.col("band").alias("__b"), F.col("part").alias("__p"), F.coalesce(offset, F.lit(0)).alias("__start"))
    within = Window.partitionBy("source", "band", "part").orderBy(F.desc(F.col("size") * F.col("times")), F.xxhash64(F.lit(2), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__start") + F.col("__run") + UNIT // 2
    rounded = (
        rated.withColumn("__run", F.sum("rate").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("band") == F.col("__b")) & (F.col("part") == F.col("__p")))
        .withColumn("copies", F.floor(end / UNIT) - F.floor((end - F.col("rate")) / UNIT))
        .select("doc_id", "source", "size", "times", "source_size", "target", F.least("copies", F.lit(CAP)).alias("copies"))
    )
    return _repaired(materialize(rounded))


def _repaired(rounded: DataFrame) -> DataFrame:
    """One more or one less copy of the entry of each source whose words are closest to what is missing, if that helps."""
    words = F.col("size") * F.col("times")
    missing = rounded.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * words)).alias("missing")).withColumnRenamed("source", "__s")
    near = (
        rounded.where("size > 0").join(missing, F.col("source").eqNullSafe(F.col("__s")))
        .where(F.when(F.col("missing") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0))
        .groupBy("source", "missing")
        .agg(F.min(F.struct(F.abs(F.abs("missing") - words).alias("off"), F.xxhash64(F.lit(4), "doc_id").alias("key"), "doc_id", "size")).alias("best"))
        .where(F.col("best.off") < F.abs("missing"))
        .select(F.col("source").alias("__s"), F.signum("missing").cast("long").alias("__step"), F.col("best.doc_id").alias("__id"), F.col("best.size").alias("__size"))
    )
    # One row a source.
    hit = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size"))
    return rounded.join(materialize(near), hit, "left").withColumn("copies", F.col("copies") + F.coalesce("__step", F.lit(0))).select(*rounded.columns)


def entries(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, source, size, times, source_size, target, copies): rows equal in the first three are one entry. Texts are read once."""
    rows = materialize(with_size(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("times")).otherwise(0)).cast("double").alias("__docs"))
    wanted = targets(totals.select("source", "source_size"), weights)
    sources = wanted.join(totals.select(F.col("source").alias("__s"), F.col("__docs").alias("source_docs")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return copies(rows, materialize(sources))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every document."""
    found = entries(docs, weights)
    return found.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("__i", "times")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed corpus: each document as often as its copies say. Rows that agree in doc_id, source and size share one entry."""
    taken = entries(docs, weights).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    sized = with_size(docs.withColumnRenamed("size", "__own")) if "size" in docs.columns else with_size(docs)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size"))
    # The plan is the side that is hashed: texts are moved once and not sorted, whatever the size.
    repeated = sized.join(taken.hint("shuffle_hash"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("size")
    if "size" in docs.columns:
        repeated = repeated.withColumnRenamed("__own", "size")
    return repeated.select(*docs.columns)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
