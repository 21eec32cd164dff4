"""Stored sketches of timings: any span within the stated errors, days replaced, drift from sketches alone."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from leafmark.operators import sketches

SCHEMA = "day date, doc_class string, status string, processing_ms double, chunk_id long"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_spans_and_replaced_days(spark, tmp_path):
    r = random.Random(2)
    rows = [(day(i % 20), "ab"[i // 20 % 2], "ok", r.lognormvariate(5, 1), i % 4000) for i in range(30_000)] + [(day(3), None, "ok", None, None)]
    metrics = spark.createDataFrame(rows, SCHEMA)
    table = sketches.stored(spark, str(tmp_path / "s"))
    assert sketches.store(sketches.daily(metrics.where("day < '2024-01-16'")), table) == 1
    assert sketches.store(sketches.daily(metrics.where("day >= '2024-01-11'")), table) == 2  # some days again
    assert table.read().count() == 20 * 2 + 1 and table.read(1).count() == 15 * 2 + 1
    for first, last in ((0, 19), (4, 9)):
        own = table.between("day", F.lit(day(first)), F.lit(day(last + 1)))
        got = {x["doc_class"]: x for x in sketches.figures(sketches.merged(own, "doc_class"), "doc_class").collect()}
        for c in "ab":
            values = sorted(v for d, k, _, v, _ in rows if k == c and day(first) <= d <= day(last))
            assert got[c]["n"] == len(values) and abs(got[c]["avg_ms"] - sum(values) / len(values)) < 1e-6 and got[c]["max_ms"] == values[-1]
            for q in sketches.QUANTILES:
                rank = sum(v <= got[c][f"p{round(q * 100)}_ms"] for v in values) / len(values)
                assert abs(rank - q) <= 2 * sketches.RANK_ERROR
            different = len({x for d, k, _, _, x in rows if k == c and day(first) <= d <= day(last)})
            assert abs(got[c]["chunks"] - different) <= sketches.DISTINCT_ERROR * different
    nothing = sketches.figures(sketches.merged(table.read().where("doc_class is null"), "doc_class"), "doc_class").first()
    assert nothing["n"] == 1 and nothing["p50_ms"] is None and nothing["chunks"] == 0


def test_drift_reads_sketches(spark):
    rows = [(day(i % 2), c, "ok", float(v * (2 if c == "slow" and i % 2 else 1)), v) for i in range(2) for c in ("slow", "same") for v in range(1, 500)]
    kept = sketches.daily(spark.createDataFrame(rows, SCHEMA))
    found = sketches.timing_drift(kept.where(F.col("day") == F.lit(day(1))), kept.where(F.col("day") == F.lit(day(0)))).collect()
    assert [r["doc_class"] for r in found] == ["slow"] and found[0]["now"] > 1.9 * found[0]["before"]
    assert sketches.timing_drift(kept, kept).count() == 0
