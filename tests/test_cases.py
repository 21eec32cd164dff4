"""Literal cases with invented names, and streams against their batch forms."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators import doc_codes, matching, pages, rankings, records, review
from leafmark.plans import tables as T
from leafmark.streaming import jobs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("rule", "value", "want"),
    [
        (lambda c: X.grade_policy(c)[0], "Pre-K", "K"), (lambda c: X.grade_policy(c)[0], "13", None), (lambda c: X.grade_policy(c)[1], "7th", "ordinal"),
        (lambda c: X.grade_policy(c)[0], "-4", None), (lambda c: X.grade_pipeline(c)[1], "kinder.", "kinder"), (X.grade_parse, "class of 2022", None),
        (X.grade_parse, "Grado: 3", "3"), (X.grade_parse, "my 5 long sentence goes on", None), (X.grade_extract, "2022", None), (X.grade_admin, "prek", "Pre-K"),
        (X.grade_bulk, "prek", "K"), (X.grade_words, "el segundo grado", 2), (X.norm_key, "  Groß\t Hof ", "gross hof"), (X.display_name, "--ps  12 west!", "PS 12 West"),
        (X.display_name, "ab", None), (X.suspicious_name, "she was here", True), (X.suspicious_name, "Alva Brook", False), (X.name_from_file, "in/alva_brook-essay.pdf", "Alva Brook"),
    ],
)
def test_text_rules(spark, rule, value, want):
    assert one(spark, rule, value) == want


def test_loose_codes(spark):
    assert one(spark, lambda c: X.codes_norm(c, loose=True), "missing_grade; EMPTY_ESSAY,low_confidence; EMPTY_ESSAY") == ["EMPTY_ESSAY", "LOW_CONFIDENCE", "MISSING_GRADE"]


def test_batches(spark):
    n = [0, 1, 30, 31, 60, 61, 90, 91, 120]
    counted = rankings.batch_count(spark.createDataFrame([(x,) for x in n], "n long")).orderBy("n")
    assert [r["batches"] for r in counted.collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    for total, want in ((37, [(0, 19), (19, 37)]), (61, [(0, 21), (21, 41), (41, 61)]), (91, [(0, 23), (23, 46), (46, 69), (69, 91)])):
        bounds = rankings.batch_bounds(spark.createDataFrame([(total,)], "n long")).orderBy("start").collect()
        assert [(r["start"], r["end"]) for r in bounds] == want


def test_rank_tie_falls_to_the_id(spark):
    rows = [(1, 1, "a", 1, "x"), (1, 1, "b", 2, "x"), (1, 2, "a", 2, "y"), (1, 2, "b", 1, "y")]
    results = rankings.rank_results(spark.createDataFrame(rows, "assignment_id long, reader_id long, submission_id string, rank_position int, reader_email string"))
    essays = spark.createDataFrame([("a", "5"), ("b", "5")], "submission_id string, grade string")
    placed = rankings.final_position(results, essays).orderBy("final_position").collect()
    assert [(r["submission_id"], r["average_rank"], r["first_votes"]) for r in placed] == [("a", 1.5, 1), ("b", 1.5, 1)]


def test_header_peaks(spark):
    rows = [(k, i, s) for k, scores in enumerate(((0.30, 0.05, 0.28, 0.03), (0.30, 0.05, 0.10, 0.03))) for i, s in enumerate(scores)]
    got = pages.header_peaks(spark.createDataFrame(rows, "doc_id int, page_index int, score double")).orderBy("doc_id").collect()
    assert [r["several_peaks"] for r in got] == [True, False]


def test_reference_tiers(spark):
    ref = spark.createDataFrame([(0, "Hilltop School"), (1, "Lake View Academy")], "ref_idx int, name string")
    names = spark.createDataFrame([(1, "HILLTOP school"), (2, "Lake View Academy West"), (3, "Hiltop Schol"), (4, "Zebra"), (5, None)], "i int, name string")
    got = {r["i"]: (r["method"], r["matched"]) for r in matching.match(names, ref).collect()}
    assert got == {1: ("exact", "Hilltop School"), 2: ("partial", "Lake View Academy"), 3: ("fuzzy_partial", "Hilltop School"), 4: ("none", None), 5: ("missing", None)}
    assert {r["i"]: r["matched"] for r in matching.canonical(names, ref).collect()}[2] == "Lake View Academy"


def test_validation_invariant(spark):
    counts = review.invariant_violations(review._validated(spark, SF)).first()
    assert counts["violations"] == 0 and counts["records"] > 0


def test_partitioning_does_not_matter(spark):
    r = T.rankings(spark, SF)
    a, b = (rankings.rank_results(x).orderBy("submission_id").collect() for x in (r.repartition(7), r.coalesce(1)))
    assert a == b


def test_csv_split_round_trip(spark, tmp_path):
    rows = T.submissions(spark, SF)
    records.write_csv_split(rows, str(tmp_path / "csv"))
    back = records.csv_counts(spark.read.option("header", True).csv(str(tmp_path / "csv")))
    assert {r["split"]: r["n"] for r in back.collect()} == {r["split"]: r["n"] for r in records.csv_counts(records.csv_columns(rows)).collect()}


def _events(spark, folder):
    T.jobs(spark, SF).repartition(3).write.parquet(folder)
    return jobs.read_events(spark, folder, T.jobs(spark, SF).schema)


def test_stream_latest_equals_batch(spark, tmp_path):
    stream = jobs.job_latest(_events(spark, str(tmp_path / "in")))
    got = jobs.drain(stream, "complete", "latest_jobs", str(tmp_path / "cp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.job_latest(T.jobs(spark, SF)).collect()))


def test_stream_completion_once(spark, tmp_path):
    stream = jobs.stream_batch_complete(_events(spark, str(tmp_path / "in")), 3)
    got = jobs.drain(stream, "append", "complete_batches", str(tmp_path / "cp")).collect()
    want = jobs.batch_complete(T.jobs(spark, SF), 3).collect()
    assert sorted(r["batch_id"] for r in got) == sorted(r["batch_id"] for r in want)


def test_stream_intake_drops_resent(spark, tmp_path):
    docs = T.read(spark, SF, "documents").select("doc_id", "text")
    docs.unionByName(docs).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_intake(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    got = jobs.drain(stream, "append", "intake", str(tmp_path / "cp"))
    assert got.count() == docs.select("text").distinct().count()


def test_dark_bands_refine_starts(spark):
    def doc(i, bands, format="image_only", confidence=0.9, starts=None):
        return [(i, k, format, len(bands), confidence, starts is None or k in starts, None if b is None else [(b, b + 0.05)]) for k, b in enumerate(bands)]

    rows = doc(1, [None, 0.1, 0.5, 0.0]) + doc(2, [None, 0.1, 0.5, 0.9]) + doc(3, [0.1, 0.1, 0.5], "hybrid") + doc(4, [0.1, 0.1, 0.5, 0.5], "native_text")
    rows += doc(5, [0.1, 0.1, 0.5, 0.5], confidence=0.2) + doc(6, [0.1, 0.1, 0.5, 0.5], starts=(0, 1, 2)) + doc(7, [0.1, 0.5, 0.14, 0.15], "hybrid")
    starts = spark.createDataFrame(rows, "doc_id long, page_index int, format string, pages long, confidence double, is_start boolean, bands array<struct<y0:double,y1:double>>")
    got = {}
    for r in pages.band_refine(starts).where("is_start").orderBy("page_index").collect():
        got.setdefault(r["doc_id"], []).append(r["page_index"])
    assert got == {1: [0, 1, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2], 4: [0, 1, 2, 3], 5: [0, 1, 2, 3], 6: [0, 1, 2], 7: [0, 2]}


@pytest.mark.parametrize(
    ("text", "grade", "school"),
    [
        ("Grade / Grado: 5\nSchool: Hilltop  High.", "5", "Hilltop High"), ("Alva Brook, Hilltop, 6th grade", "6", None), ("Grade: 13\n6th grade", None, None), ("grado pre-k", "pre-k", None),
        ("School and if anything", None, None), ("the campus - West Hill", None, "West Hill"), ("", None, None), (None, None, None),
    ],
)
def test_fields_of_whole_texts(spark, text, grade, school):
    assert one(spark, doc_codes.text_grade, text) == grade
    assert one(spark, doc_codes.text_school, text) == school


def test_codes_of_documents(spark):
    rows = [(1, " a\nb", None, None, False, True), (2, "x", None, None, True, True), (3, None, "5", "Hilltop", False, False), (4, None, "5", None, False, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string, school_name string, template boolean, low_confidence boolean")
    got = {r["doc_id"]: (r["codes"], {k: v["snippet"] for k, v in r["evidence"].items()}) for r in doc_codes.doc_codes(docs).collect()}
    missing = ["MISSING_GRADE", "MISSING_SCHOOL_NAME"]
    assert got[1] == (missing + ["OCR_LOW_CONFIDENCE"], {"grade": "a\nb", "school_name": "a\nb"})
    assert got[2] == (["OCR_LOW_CONFIDENCE", "TEMPLATE_ONLY"], {}) and got[3] == ([], {}) and got[4] == (missing[1:], {"school_name": ""})
