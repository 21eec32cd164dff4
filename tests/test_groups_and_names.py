"""Numbering without sorting whole groups, and names matched by keys, each against its plain definition."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmark.operators import matching, rankings
from leafmark.streaming import jobs


def test_numbers_are_those_of_one_window(spark):
    rows = spark.range(400).select(
        F.col("id"),
        F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 7 < 5, 1).otherwise(F.col("id") % 7)).alias("grade"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 5 / 3).alias("a"),
        (F.col("id") * 31 % 4).alias("b"),
    )
    got = rankings.numbered(rows, "grade", {"a": False, "b": True}, F.col("id").cast("string"), "n")
    one = Window.partitionBy("grade").orderBy("a", F.desc("b"), F.col("id").cast("string"))
    want = rows.withColumn("n", F.row_number().over(one))
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert rankings.numbered(rows.where("false"), "grade", {"a": False}, F.col("id"), "n").count() == 0


def test_completion_falls_into_an_hour(spark):
    events = spark.range(300).select(
        (F.col("id") % 3).alias("batch_id"), F.col("id").alias("event_id"), F.lit("finished").alias("status"), F.timestamp_seconds(F.col("id") * 37 % 50 * 600).alias("ts")
    )
    for wanted in (1, 17, 100, 101):
        order = Window.partitionBy("batch_id").orderBy("ts", "event_id")
        want = events.withColumn("n", F.row_number().over(order)).where(F.col("n") == wanted).select("batch_id", F.col("ts").alias("completed_at"))
        assert sorted(jobs.batch_complete(events, wanted).collect()) == sorted(want.collect())


def test_next_job_takes_values_then_age(spark):
    rows = [(1, 1, 7, "queued", 5.0, 3), (1, 2, 7, "queued", 5.0, 2), (1, 3, 7, "queued", None, 1), (1, 4, 7, "done", 9.0, 0), (2, 5, 8, "queued", None, 4), (2, 6, 8, "queued", None, 4)]
    events = spark.createDataFrame(rows, "batch_id long, event_id long, job_id long, status string, value double, ts long")
    assert sorted(map(tuple, jobs.next_job(events).collect())) == [(1, 2, 7), (2, 5, 8)]


def _norm(name):
    return re.sub(r"[^a-z0-9]+", " ", name.lower().replace("ß", "ss")).strip()


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def _close(x, y):
    p, q = ([w for w in s.split() if len(w) >= 2] for s in (x, y))
    short, long = (p, q) if len(p) <= len(q) else (q, p)
    return bool(short) and all(max((_ratio(w, v) for v in long), default=0) >= 0.8 for w in short)


def _plain(name, refs, canonical):
    """The tiers as loops over the whole reference."""
    if not (name or "").strip():
        return "missing", 0.0, None
    n, known = _norm(name), [(i, r, _norm(r)) for i, r in refs]
    tiers = [("exact", 1.0, lambda m: n == m), ("partial", 0.95, lambda m: n in m or m in n)]
    if not canonical:
        tiers.append(("fuzzy_partial", 0.9, lambda m: _close(n, m)))
    for method, confidence, fits in tiers:
        if found := [r for _, r, m in known if fits(m)]:
            return method, confidence, found[0]
    shared = lambda m: {w for w in n.split() if len(w) > 1} & {w for w in m.split() if len(w) > 1}
    near = [(_ratio(n, m), -i, r) for i, r, m in known if not canonical or shared(m)]
    best = max((x for x in near if x[0] >= (0.78 if canonical else 0.8)), default=None)
    return ("fuzzy", best[0], best[2]) if best else ("none", 0.0, None)


REFS = [
    "Hilltop School", "Lake View Academy", "hilltop  SCHOOL", "PS 12", "K", "North Ridge Elementary", "Northridge Elementary", "St. Mary's High", "Straße Schule",
    "Washington Carver", "Carver Washington Middle", "Oak", "Oakdale", "abcd", "bcde",
]
NAMES = [
    "HILLTOP school", "hiltop schol", "lake view academy west", "View", "ps", "12", "k", "north ridge elementry", "nrthrdge elemntary", "saint marys high", "strasse schule", "carver washingtn",
    "oak", "oa", "oakdal", "abcde", "zebra", "??", "", "  ", None, "x" * 3000, "Lake Viewacademy", "acbd", "q w e r", "Midle Washington", "nrth rdge", "Hilltop School", "lakeviewacademy",
]


@pytest.mark.parametrize("block", [50_000, 4])
@pytest.mark.parametrize("empty", [False, True])
def test_tiers_are_those_of_plain_loops(spark, monkeypatch, block, empty):
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)
    refs = list(enumerate(REFS + ["--"] * empty))
    names = spark.createDataFrame(list(enumerate(NAMES)), "i int, name string")
    reference = spark.createDataFrame(refs, "ref_idx int, name string")
    for operator, canonical in ((matching.match, False), (matching.canonical, True)):
        got = {r["i"]: (r["method"], pytest.approx(r["confidence"]), r["matched"]) for r in operator(names, reference).collect()}
        assert got == {i: _plain(n, refs, canonical) for i, n in enumerate(NAMES)}


def test_names_that_share_a_frequent_word(spark, monkeypatch):
    """All names hold "school": answers are those of plain loops in any blocks, and few of the pairs are compared by difflib."""
    import random

    r = random.Random(5)
    part = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    refs = [(i, f"{part()} {part()} school".title()) for i in range(150)]
    names = []
    for i in range(150):
        base = list(refs[r.randrange(150)][1].lower())
        for _ in range(r.randint(1, 4)):
            base[r.randrange(len(base) - 7)] = r.choice("aeioubcd")
        names.append((i, "".join(base)))
    frames = spark.createDataFrame(names, "i int, name string"), spark.createDataFrame(refs, "ref_idx int, name string")
    want = {i: _plain(n, refs, True) for i, n in names}
    assert sum(m == "fuzzy" for m, *_ in want.values()) > 50
    for most in (20_000, 30):
        monkeypatch.setattr(matching, "WORD_NAMES", most)
        monkeypatch.setattr(matching, "WORD_REFS", most)
        got = {r["i"]: (r["method"], pytest.approx(r["confidence"]), r["matched"]) for r in matching.canonical(*frames).collect()}
        assert got == want
    norms, known = matching._with_letters(matching._norms(frames[0]), "norm", "letters"), matching._with_letters(matching._reference(frames[1]), "ref_norm", "ref_letters")
    pairs = matching._sharing_a_word(norms, known, matching.similar_enough(0.78))
    assert pairs.count() == pairs.select("norm", "ref_norm").distinct().count() <= 0.1 * 150 * 150


def test_no_reference_matches_nothing(spark):
    names, reference = spark.createDataFrame([(1, "a b"), (2, "?")], "i int, name string"), spark.createDataFrame([], "ref_idx int, name string")
    assert {r["method"] for r in matching.match(names, reference).collect()} == {"none"}


@pytest.mark.parametrize("query, canonical", [("ref_match_fuzzy", False), ("canon_resolve", True)])
def test_registered_queries_are_those_of_plain_loops(spark, query, canonical):
    refs = [(r["ref_idx"], r["name"]) for r in matching.reference(spark, SF).orderBy("ref_idx").collect()]
    for r in matching.QUERIES[query](spark, SF).collect():
        assert (r["method"], pytest.approx(r["confidence"]), r["matched"]) == _plain(r["name"], refs, canonical)
