"""Checks of validated records while they are written: one pass gives the table and its figures.

The figures are observed metrics of the plan that writes, so records are neither read again nor validated twice. Rows go beside their place first; only if
the figures stay within the bounds are they moved there, else the run fails and what was there before stays. Streams do the same for each
micro-batch, so a bad one stops the query before it is committed and is tried again once the query starts anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leafmark.operators import review
from leafmark.plans import tables as T
from leafmark.sources.folders import open_root
from leafmark.sources.shared import shared_dir


class BoundExceeded(RuntimeError):
    """More records than allowed fail a check; figures holds what was observed."""

    def __init__(self, figures: dict[str, int], name: str, most: float) -> None:
        super().__init__(f"{name}: {figures[name]} of {figures['records']} records, allowed are {most:.2%}")
        self.figures = figures


@dataclass(frozen=True)
class Check:
    """A condition that records should not meet, and the share of them that may."""

    name: str
    broken: Column
    most: float = 0.0


def invariant() -> Check:
    """Records need review exactly if they have codes."""
    return Check("violations", F.col("review") != (F.col("codes") != ""))


def with_expected(validated: DataFrame, expected: DataFrame) -> DataFrame:
    """validated with lacking, the number of expected codes (doc_id, code) that each record lacks."""
    wanted = expected.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("code").alias("__codes"))
    lacking = F.coalesce(F.size(F.filter("__codes", lambda c: ~F.array_contains(F.split("codes", ";"), c))), F.lit(0))
    return validated.join(wanted, F.col("doc_id") == F.col("__id"), "left").withColumn("lacking", F.when(F.col("__id").isNull(), 0).otherwise(lacking)).drop("__id", "__codes")


def write_checked(rows: DataFrame, path: str, checks: list[Check], figures: dict[str, Column] | None = None) -> dict[str, int]:
    """Write rows to path as Parquet if no check fails on more than its share of them; what was observed: records, each check, and further figures.

    path must not be there yet.
    """
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    wanted = [F.count(F.lit(1)).alias("records"), *[F.count_if(c.broken).alias(c.name) for c in checks], *[c.alias(n) for n, c in (figures or {}).items()]]
    fs, place = open_root(path)
    above, _, own = place.rpartition("/")
    beside = f"_{own}-{uuid.uuid4().hex}"
    rows.observe(seen, *wanted).write.parquet(f"{path.rpartition('/')[0]}/{beside}")
    found = {k: v or 0 for k, v in seen.get.items()}
    for c in checks:
        if found[c.name] > c.most * found["records"]:
            fs.delete_dir(f"{above}/{beside}")
            raise BoundExceeded(found, c.name, c.most)
    fs.move(f"{above}/{beside}", place)
    return found


def checking(path: str, checks: list[Check], then: Callable[[int, dict[str, int]], None] = lambda number, figures: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each micro-batch to a folder of its number, checked; then gets its figures.

    A batch that comes again after a restart replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        fs, place = open_root(f"{path}/batch={number}")
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        if fs.get_file_info(place).type.name == "Directory":
            fs.delete_dir(place)
        then(number, write_checked(batch, f"{path}/batch={number}", checks))

    return write


def _observed(s, d):
    """Figures of the validated records, taken while they are written."""
    rows = with_expected(review._validated(s, d), review._expected(s, d))
    path = shared_dir(s)
    found = write_checked(rows, path, [invariant()], {"in_review": F.count_if("review"), "lacking": F.sum("lacking")})
    return s.createDataFrame([(found["violations"], found["records"], found["in_review"], found["lacking"])], "violations long, records long, in_review long, lacking long")


QUERIES = {"validate_observed": _observed}
ORACLE = {
    "validate_observed": T.sql(
        """e as (select doc_id, case when doc_id % 8 = 0 then 'MISSING_GRADE' else 'TEMPLATE_ONLY' end as code from submissions where doc_id % 4 = 0)
        select 0::bigint as violations, count(*) as records, count(*) filter (codes <> '') as in_review,
          (select count(*) from e join validated v using (doc_id) where not list_contains(string_split(v.codes, ';'), e.code)) as lacking from validated""", T.SUBMISSIONS, review.CHECKED,
    ),
}
