"""Mergeable sketches of stage timings: stored per day and class, merged for any span.

A day's quantiles and distinct counts are KLL and HyperLogLog sketches, made by one aggregation with partial sums on the map side and stored with exact
counts, sums and maxima. Reports over a span, by any coarser key, and drift between spans read stored sketches only, a row for each day and
class, never the metrics again.

A quantile is that of a rank within RANK_ERROR of the wanted one (99 % of the time), a distinct count within DISTINCT_ERROR. Null timings are not in
sketches but count as rows; a group without any has null quantiles and no distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.plans import tables as T
from leafmark.sources.shared import shared_dir
from leafmark.sources.stored import StoredTable

#: Size of quantile sketches and logarithm of the size of distinct counts, with the errors that follow.
KLL_K, RANK_ERROR = 1000, 0.005
HLL_BITS, DISTINCT_ERROR = 14, 0.03
QUANTILES = (0.5, 0.9, 0.99)
KEYS = ("doc_class", "status")


def daily(metrics: DataFrame) -> DataFrame:
    """Sketches of metrics (day, doc_class, status, processing_ms, chunk_id) by day, class and status."""
    return metrics.groupBy("day", *KEYS).agg(
        F.count("*").alias("n"), F.count("processing_ms").alias("timed"), F.sum("processing_ms").alias("sum_ms"), F.max("processing_ms").alias("max_ms"),
        F.kll_sketch_agg_double("processing_ms", KLL_K).alias("quantiles"), F.hll_sketch_agg("chunk_id", HLL_BITS).alias("chunks"),
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row a key, of all rows of sketches with it."""
    return sketches.groupBy(*keys).agg(
        *[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "timed"), (F.sum, "sum_ms"), (F.max, "max_ms"))],
        F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"), F.hll_union_agg("chunks").alias("chunks"),
    )


def figures(sketches: DataFrame, *keys: str) -> DataFrame:
    """What merged sketches say: n, average, maximum, quantiles and distinct chunks."""
    at = lambda q: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"p{round(q * 100)}_ms")
    return sketches.select(*keys, "n", (F.col("sum_ms") / F.col("timed")).alias("avg_ms"), "max_ms", *map(at, QUANTILES), F.hll_sketch_estimate("chunks").alias("chunks"))


def stored(spark: SparkSession, root: str) -> StoredTable:
    """The table of daily sketches below root, in order of days: read spans with between("day", ...)."""
    return StoredTable(spark, root, ("day",), ("day",))


def store(sketches: DataFrame, table: StoredTable) -> int:
    """Put days into the table; a day that is there already is replaced, and no other."""
    return table.upsert(sketches) if table.versions() else table.create(sketches)


def timing_drift(now: DataFrame, before: DataFrame, limit: float = 0.10) -> DataFrame:
    """Classes whose p90 rose by more than a share of what it was, from the sketches of two spans."""
    rows = lambda df, name: figures(merged(df, *KEYS), *KEYS).select(*[F.col(k).alias(f"{name}_{k}") for k in KEYS], F.col("p90_ms").alias(name))
    same = [F.col(f"now_{k}").eqNullSafe(F.col(f"before_{k}")) for k in KEYS]
    both = rows(now, "now").join(rows(before, "before"), same[0] & same[1])
    return both.where((F.col("now") - F.col("before")) > limit * F.col("before")).select(*[F.col(f"now_{k}").alias(k) for k in KEYS], "before", "now")


def exact(metrics: DataFrame) -> DataFrame:
    """The quantiles themselves: for each class the least timing that at least so many are not above."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by processing_ms)").alias(f"p{round(q * 100)}_ms")
    return metrics.groupBy(*KEYS).agg(F.count("*").alias("n"), *map(at, QUANTILES), F.count_distinct("chunk_id").alias("chunks"))


def within_error(metrics: DataFrame, sketches: DataFrame) -> DataFrame:
    """For each class, whether the sketches' quantiles have ranks, and their distinct count a size, within the stated errors."""
    said = F.broadcast(figures(merged(sketches, *KEYS), *KEYS).select(*[F.col(k).alias(f"__{k}") for k in KEYS], *[f"p{round(q * 100)}_ms" for q in QUANTILES], F.col("chunks").alias("said")))  # a row a class
    joined = metrics.join(said, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]))
    ranks = []
    for q in QUANTILES:
        value, n = F.col(f"p{round(q * 100)}_ms"), F.count("processing_ms")
        low, high = F.count_if(F.col("processing_ms") < value) / n, F.count_if(F.col("processing_ms") <= value) / n
        ranks.append(((low <= q + RANK_ERROR) & (high >= q - RANK_ERROR)).alias(f"p{round(q * 100)}"))
    distinct = F.count_distinct("chunk_id")
    return joined.groupBy(*KEYS).agg(F.count("*").alias("n"), *ranks, (F.abs(F.max("said") - distinct) <= DISTINCT_ERROR * distinct).alias("chunks"))


def _metrics(s, d):
    """Stage timings with their day and chunk."""
    return T.read(s, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("doc_class"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("processing_ms"), F.col("l_orderkey").alias("chunk_id")
    )


def _within(s, d):
    """Sketches of each day, stored and read back, against the metrics themselves."""
    table = stored(s, shared_dir(s))
    store(daily(_metrics(s, d)), table)
    return within_error(_metrics(s, d), table.read())


QUERIES = {"stage_percentiles": lambda s, d: exact(_metrics(s, d)), "stage_sketches": _within}
_SQL = "m as (select l_returnflag as doc_class, l_linestatus as status, l_extendedprice as processing_ms, l_orderkey as chunk_id from lineitem)"
ORACLE = {
    "stage_percentiles": f"with {_SQL} select doc_class, status, count(*) as n, {', '.join(f'quantile_disc(processing_ms, {q}) as p{round(q * 100)}_ms' for q in QUANTILES)}, count(distinct chunk_id) as chunks from m group by all",
    "stage_sketches": f"with {_SQL} select doc_class, status, count(*) as n, true as p50, true as p90, true as p99, true as chunks from m group by all",
}
