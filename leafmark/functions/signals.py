"""Signals of page texts: overlays, form layouts, first pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.plans import tables as T

# Fixed values.
NAV = (
    r"^english +page +\d+\b",
    r"^(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday), +[a-z]+ +\d{1,2}, +\d{4}$",
    r"^\d{1,2}:\d{2} *(?:am|pm)$",
    r"^(?:father|mother|grandfather|stepdad|father-figure)$",
)
TOP = ("ifi fatherhood essay contest", "illinois fatherhood initiative", "student's name", "student name", "nombre del estudiante", "grade", "grado", "school", "escuela")
BOTTOM = ("email", "phone", "father/father-figure name", "father/father-figure", "father-figure name", "nombre del padre", "figura paterna", "teléfono", "telefono")
SCANNED_TOP = TOP + ("studnt", "estudiante", "garde", "grad", "schol")
SCANNED_BOTTOM = BOTTOM + ("father", "padre", "figura")
BOILERPLATE = ("ifi fatherhood essay contest", "illinois fatherhood initiative", "student name", "student's name", "father/father-figure", "writing about", "character maximum", "school / escuela", "school:", "grade / grado")
NO_NAME = ("student", "essay", "fatherhood", "initiative", "contest")
GRADE_SIGNS = (r"\b(?:k|kinder|kindergarten)\b", r"\b[1-9][0-2]?(?:st|nd|rd|th)? *grade\b", r"grade *[:\-]? *[1-9][0-2]?")


def hits(low: Column, parts: tuple[str, ...]) -> Column:
    return sum((low.contains(p).cast("int") for p in parts), F.lit(0))


def nav_overlay(c: Column) -> Column:
    """At least three lines of a viewer's overlay, and at least 70 % of all."""
    lines = F.filter(F.transform(F.split(F.lower(c), "\n"), X.trimmed), lambda x: x != "")
    nav = F.size(F.filter(lines, lambda x: x.rlike("|".join(NAV))))
    return (nav >= 3) & (nav >= F.size(lines) * 0.7)


def typed_form(c: Column) -> Column:
    low = F.lower(F.translate(c, "’‘", "''"))
    kami = low.contains("kami")
    return (F.length(X.trimmed(c)) >= 50) & ((low.contains("ifi") & low.contains("fatherhood")) | kami) & (hits(low, TOP) >= 2) & ((hits(low, BOTTOM) >= 1) | kami)


def scanned_form(c: Column) -> Column:
    low = F.lower(F.translate(c, "’‘", "''"))
    contest = (low.contains("ifi") & low.contains("fatherhood")) | (low.contains("essay") & low.contains("father"))
    return (F.length(X.trimmed(c)) >= 30) & contest & (hits(low, SCANNED_TOP) >= 1) & (hits(low, SCANNED_BOTTOM) >= 1)


def startpage_signals(c: Column) -> dict[str, Column]:
    """Boilerplate, a plausible name, grade and school in a page's top."""
    low = F.lower(c)
    alpha = F.filter(X.words(c), lambda w: w.rlike(r"^\p{L}+$"))
    joined = F.lower(F.array_join(alpha, " "))
    return {
        "boilerplate": hits(low, BOILERPLATE) > 0,
        "name": F.size(alpha).between(2, 5) & (hits(joined, NO_NAME) == 0),
        "grade": low.rlike("|".join(GRADE_SIGNS)),
        "school": (low.contains("school") | low.contains("escuela")) & (F.size(alpha) >= 2),
    }


def _top():
    """Page tops of several kinds."""
    i = F.col("doc_id")
    n = F.concat(F.lit("English Page "), (i % 9).cast("string"), F.lit("\nMonday, May 4, 2020\n10:15 am\nfather\n"))
    return (
        F.when(i % 6 == 0, n).when(i % 6 == 1, "IFI Fatherhood Essay Contest\nStudent’s Name\nGrade: 7\nSchool:\nPhone\n").when(i % 6 == 2, "Essay by a studnt\nmy father, padre\n")
        .when(i % 6 == 3, "Alva Brook\n5th grade\nHill School\n").when(i % 6 == 4, "kami export: school grade\n").otherwise("")
    )


def _whole(s, d):
    """Whole documents below tops of several kinds."""
    return T.read(s, d, "documents").select("doc_id", F.concat(_top(), "text").alias("text"))


QUERIES = {
    "nav_overlay": lambda s, d: _whole(s, d).select("doc_id", nav_overlay(F.col("text")).alias("overlay")),
    "form_detect": lambda s, d: _whole(s, d).select("doc_id", typed_form(F.col("text")).alias("typed"), scanned_form(F.col("text")).alias("scanned")),
    "startpage_signals": lambda s, d: _whole(s, d).select("doc_id", *[v.alias(k) for k, v in startpage_signals(F.col("text")).items()]),
    "nav_overlay_whole": lambda s, d: _whole(s, d).select("doc_id", nav_overlay(F.col("text")).alias("overlay")),
    "form_detect_whole": lambda s, d: _whole(s, d).select("doc_id", typed_form(F.col("text")).alias("typed"), scanned_form(F.col("text")).alias("scanned")),
    "startpage_signals_pages": lambda s, d: T.pages(s, d).select("doc_id", "page_index", *[v.alias(k) for k, v in startpage_signals(F.col("text")).items()]),
}

_TOPS = r"""
tops as (select doc_id, case doc_id % 6 when 0 then 'English Page ' || (doc_id % 9) || chr(10) || 'Monday, May 4, 2020' || chr(10) || '10:15 am' || chr(10) || 'father' || chr(10)
  when 1 then 'IFI Fatherhood Essay Contest' || chr(10) || 'Student’s Name' || chr(10) || 'Grade: 7' || chr(10) || 'School:' || chr(10) || 'Phone' || chr(10)
  when 2 then 'Essay by a studnt' || chr(10) || 'my father, padre' || chr(10) when 3 then 'Alva Brook' || chr(10) || '5th grade' || chr(10) || 'Hill School' || chr(10)
  when 4 then 'kami export: school grade' || chr(10) else '' end || text as text from documents)
"""
_T = r"regexp_replace({}, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')"


def _hits(c, parts):
    return "(" + " + ".join("contains({}, '{}')::int".format(c, p.replace("'", "''")) for p in parts) + ")"


_LOW = "l as (select doc_id, text, lower(translate(text, '’‘', '''''')) as low from tops)"
ORACLE = {
    "nav_overlay": T.sql(rf"t as (select doc_id, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: {_T.format('x')}), lambda x: x <> '') as l from tops), n as (select *, len(list_filter(l, lambda x: regexp_matches(x, '{'|'.join(NAV)}'))) as nav from t) select doc_id, nav >= 3 and nav >= len(l) * 0.7 as overlay from n", _TOPS),
    "form_detect": T.sql(f"""select doc_id, length({_T.format('text')}) >= 50 and ((contains(low, 'ifi') and contains(low, 'fatherhood')) or contains(low, 'kami')) and {_hits('low', TOP)} >= 2 and ({_hits('low', BOTTOM)} >= 1 or contains(low, 'kami')) as typed,
      length({_T.format('text')}) >= 30 and ((contains(low, 'ifi') and contains(low, 'fatherhood')) or (contains(low, 'essay') and contains(low, 'father'))) and {_hits('low', SCANNED_TOP)} >= 1 and {_hits('low', SCANNED_BOTTOM)} >= 1 as scanned from l""", _TOPS, _LOW),
    "startpage_signals": T.sql(rf"""a as (select doc_id, lower(text) as low, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda w: regexp_full_match(w, '\pL+')) as w from tops), b as (select *, lower(array_to_string(w, ' ')) as j from a)
      select doc_id, {_hits('low', BOILERPLATE)} > 0 as boilerplate, len(w) between 2 and 5 and {_hits('j', NO_NAME)} = 0 as name, regexp_matches(low, '{'|'.join(GRADE_SIGNS)}') as grade,
        (contains(low, 'school') or contains(low, 'escuela')) and len(w) >= 2 as school from b""", _TOPS),
}
# Earlier names of the same statements; pages stand for documents in the last.
ORACLE |= {f"{k}_whole": ORACLE[k] for k in ("nav_overlay", "form_detect")}
ORACLE["startpage_signals_pages"] = ORACLE["startpage_signals"].replace(_TOPS, T.PAGES).replace("from tops", "from doc_pages").replace("select doc_id,", "select doc_id, page_index,")
