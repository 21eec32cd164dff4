"""Attribution by similarity against its definition, on the registered queries and on rows made for it."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest
from conftest import SF

from leafmark.operators import pages as P
from leafmark.operators import similar_pages
from leafmark.plans import tables as T


def norm(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower().replace("ß", "ss")).strip()


def ratio(value, text):
    n = norm(value)
    lines = [m for m in map(norm, (text or "").splitlines()) if m]
    return max((SequenceMatcher(None, n, m).ratio() for m in lines), default=0.0) if n else 0.0


def confidence(r):
    if r >= 0.92:
        return round(min(0.95, max(0.85, 0.85 + (r - 0.92) / 0.08 * 0.10)), 6)
    return round(min(0.85, max(0.70, 0.70 + (r - 0.85) / 0.07 * 0.15)), 6) if r >= 0.85 else None


def attribute(value, own):
    """(page, confidence, method) of a value over (page, text) in order: the first page that holds it or has a line that is similar enough."""
    n = norm(value)
    for page, text in own if n else []:
        if value in (text or ""):
            return page, 1.0, "exact_match"
        if n in norm(text):
            return page, 0.9, "normalized_contains"
        if c := confidence(ratio(value, text)):
            return page, c, "fuzzy_match"
    return None, None, None


def check(fields, pages):
    texts: dict = {}
    for r in pages.collect():
        texts.setdefault(r["doc_id"], []).append((r["page_index"], r["text"]))
    want, lost = {}, {}
    for r in fields.collect():
        own = [x for x in sorted(texts.get(r["doc_id"], [])) if r["start_page"] <= x[0] <= r["end_page"]]
        key = r["doc_id"], r["field"]
        want[key] = attribute(r["value"], own)
        if want[key][0] is None:
            lost[key] = sorted(((ratio(r["value"], text), page, text) for page, text in own), key=lambda x: (-x[0], x[1]))[:3]
    got = {(r["doc_id"], r["field"]): (r["page_index"], r["confidence"], r["method"]) for r in similar_pages.attributed(fields, pages).collect()}
    assert got.keys() == want.keys()
    for k, (page, c, method) in want.items():
        assert got[k] == (page, c if c is None else pytest.approx(c, abs=2e-6), method), k
    top = {(r["doc_id"], r["field"], r["place"]): (r["page_index"], r["score"], r["snippet"]) for r in similar_pages.candidates(fields, pages).collect()}
    assert top == {(*k, i): (page, pytest.approx(r, abs=1e-6), (text or "")[:200] if text is not None else None) for k, rows in lost.items() for i, (r, page, text) in enumerate(rows, 1)}
    return want


def test_registered_queries(spark):
    check(P._fields(spark, SF), T.pages(spark, SF))


def test_every_method(spark):
    pages = [(1, 0, "nothing here"), (1, 1, "Name: x\nHilltop Schol"), (1, 2, "Hilltop School"), (2, 0, "hilltop   SCHOOL!"), (2, 1, "Hilltop School"), (3, 0, "other"), (3, 1, None), (3, 2, "Hill"), (3, 3, "Hilltops"), (4, 0, "")]
    fields = [(1, "f", "Hilltop School", 0, 2), (1, "g", "Hilltop School", 2, 2), (2, "f", "Hilltop School", 0, 1), (3, "f", "Hilltop School", 0, 3), (4, "f", "x", 0, 9), (1, "h", "--", 0, 2), (5, "f", "no pages", 0, 1)]
    want = check(spark.createDataFrame(fields, "doc_id long, field string, value string, start_page int, end_page int"), spark.createDataFrame(pages, "doc_id long, page_index int, text string"))
    assert [want[k][2] for k in ((1, "f"), (1, "g"), (2, "f"), (3, "f"), (1, "h"))] == ["fuzzy_match", "exact_match", "normalized_contains", None, None]
