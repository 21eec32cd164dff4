"""Observed checks: figures of the written rows, bounds that fail a run, and streams."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from leafmark import registry
from leafmark.operators import checked, review
from leafmark.plans import tables as T


def rows_of(spark, n, bad):
    return spark.range(n).select("id", (F.col("id") >= bad).alias("review"), F.lit("X").alias("codes"))


def test_figures_are_those_of_queries(spark, duck, same, tmp_path):
    same(registry.queries()["validate_observed"](spark, SF), duck.sql(registry.oracle_sql()["validate_observed"]))
    rows = review._validated(spark, SF)
    found = checked.write_checked(rows, str(tmp_path / "v"), [checked.invariant()])
    assert found == review.invariant_violations(rows).first().asDict()
    assert spark.read.parquet(str(tmp_path / "v")).count() == found["records"] == T.submissions(spark, SF).count()
    lacking = checked.with_expected(rows, review._expected(spark, SF)).agg(F.sum("lacking")).first()[0]
    assert lacking == review.expectations(rows, review._expected(spark, SF)).count() > 0


def test_a_bound_fails_the_run_and_leaves_nothing(spark, tmp_path):
    with pytest.raises(checked.BoundExceeded) as error:
        checked.write_checked(rows_of(spark, 100, 3), str(tmp_path / "out"), [checked.invariant()])
    assert error.value.figures == {"records": 100, "violations": 3} and not list(tmp_path.iterdir())
    loose = checked.Check("violations", checked.invariant().broken, 0.03)
    assert checked.write_checked(rows_of(spark, 100, 3), str(tmp_path / "out"), [loose])["violations"] == 3
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert checked.write_checked(rows_of(spark, 0, 0), str(tmp_path / "none"), [checked.invariant()], {"s": F.sum("id")}) == {"records": 0, "violations": 0, "s": 0}


def test_streams_stop_at_a_bad_batch_and_go_on(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for k, bad in enumerate((0, 2)):
        rows_of(spark, 10, bad).coalesce(1).write.parquet(str(folder / f"n={k}"))
    seen = {}

    def run(most):
        stream = spark.readStream.schema(rows_of(spark, 0, 0).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        check = checked.Check("violations", checked.invariant().broken, most)
        query = stream.writeStream.foreachBatch(checked.checking(out, [check], seen.__setitem__)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="allowed are"):
        run(0.0)
    assert spark.read.parquet(f"{out}/batch=0").count() == 10 and [p.name for p in (tmp_path / "out").iterdir()] == ["batch=0"]
    run(0.5)
    assert spark.read.parquet(out).count() == 20 and sum(f["violations"] for f in seen.values()) == 2
