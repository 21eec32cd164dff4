"""Reason codes of whole documents, from the text of all their pages.

A document is a row with its text; extraction and codes are one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import fixed as V
from leafmark.functions import plausible as P
from leafmark.functions import text as X
from leafmark.functions.text import let
from leafmark.operators import pages
from leafmark.plans import tables as T


def _first(c: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches captures; only a line feed ends a line."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, "(?d)" + p, 1), F.lit("")) for p in patterns])


def text_grade(c: Column) -> Column:
    """The grade that the first matching pattern finds, as written; null if it is none from 1 to 12 nor kindergarten."""
    good = lambda g: F.upper(g).isin(*V.TEXT_KINDER) | F.coalesce(g.try_cast("int").between(1, 12), F.lit(False))
    return let(X.trimmed(_first(c, V.TEXT_GRADES)), lambda g: F.when(good(g), g))


def text_school(c: Column) -> Column:
    """What follows a school label on its line; null where that is the start of a sentence."""
    shown = F.regexp_replace(F.regexp_replace(_first(c, V.TEXT_SCHOOLS), X.SPACE + "+", " "), r"^[ .,:;\-]+|[ .,:;\-]+$", "")
    return let(shown, lambda s: F.when((s != "") & ~P.fragment(s), s))


def doc_codes(docs: DataFrame) -> DataFrame:
    """docs (text, grade, school_name, template, low_confidence) with sorted codes and evidence of each missing field.

    A template has no further codes and no evidence. Evidence is a map from the field to its source, the patterns that were tried
    and the head of the text. A null text is empty.
    """
    head = F.substring(X.trimmed(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 20), "\n")), 1, 300)
    plain = ~F.col("template")
    missing = {"grade": (plain & F.col("grade").isNull(), V.TEXT_GRADES), "school_name": (plain & F.col("school_name").isNull(), V.TEXT_SCHOOLS)}
    codes = F.array(
        F.when(missing["grade"][0], "MISSING_GRADE"),
        F.when(missing["school_name"][0], "MISSING_SCHOOL_NAME"),
        F.when(F.col("low_confidence"), "OCR_LOW_CONFIDENCE"),
        F.when(F.col("template"), "TEMPLATE_ONLY"),
    )
    proof = lambda patterns: F.struct(F.lit(V.TEXT_SOURCE).alias("source"), F.array(*[F.lit(p) for p in patterns]).alias("patterns"), F.col("__head").alias("snippet"))
    entries = F.array(*[F.when(test, F.struct(F.lit(k).alias("key"), proof(patterns).alias("value"))) for k, (test, patterns) in missing.items()])
    return docs.withColumn("__head", head).withColumns({"codes": F.array_compact(codes), "evidence": F.map_from_entries(F.array_compact(entries))}).drop("__head")


def _documents(s, d):
    i = F.col("doc_id")
    line = (
        F.when(i % 4 == 1, F.concat(F.lit("Grade / Grado: "), (i % 16).cast("string"), F.lit("\n")))
        .when(i % 4 == 2, F.concat(F.lit("North Hill, "), (i % 16).cast("string"), F.lit("th grade\nGrado: pre-K\n")))
        .when(i % 4 == 3, F.concat(F.lit("Escuela: "), F.when(i % 3 == 0, "and if anything").otherwise("- Del  Sol ."), F.lit("\n")))
        .otherwise("")
    )
    texts = pages.assemble_text(T.pages(s, d)).withColumn("text", F.concat(line, F.coalesce("text", F.lit(""))))
    found = texts.withColumns({"grade": text_grade(F.col("text")), "school_name": text_school(F.col("text"))})
    return found.withColumns({"template": i % 9 == 6, "low_confidence": i % 5 == 0})


def _codes(s, d):
    e = F.col("evidence")
    return doc_codes(_documents(s, d)).select(
        "doc_id", "grade", "school_name", F.array_join("codes", ";").alias("codes"), e["grade"]["snippet"].alias("grade_snippet"), e["school_name"]["source"].alias("school_source"), F.size(e["grade"]["patterns"]).alias("grade_patterns")
    )


QUERIES = {"doc_codes": _codes}


def _sql_first(c: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {P.quote(p)}, 1), '')" for p in patterns) + ")"


_GRADE = P.sql_let(P.sql_trim(_sql_first("text", V.TEXT_GRADES)), lambda g: f"case when {P.sql_in(f'upper({g})', V.TEXT_KINDER)} or try_cast({g} as int) between 1 and 12 then {g} end")
_SCHOOL = P.sql_let(
    f"regexp_replace(regexp_replace({_sql_first('text', V.TEXT_SCHOOLS)}, '{X.SPACE}+', ' ', 'g'), '^[ .,:;\\-]+|[ .,:;\\-]+$', '', 'g')",
    lambda s: f"case when {s} <> '' and not {P.sql_fragment(s)} then {s} end",
)
ORACLE = {
    "doc_codes": T.sql(
        rf"""a as (select doc_id, case when count(*) > 1 and bool_or(trim(text) = '') then '' else string_agg(text, chr(10) || chr(10) order by page_index) end as body from doc_pages group by 1),
      t as (select doc_id, case doc_id % 4 when 1 then 'Grade / Grado: ' || (doc_id % 16) || chr(10) when 2 then 'North Hill, ' || (doc_id % 16) || 'th grade' || chr(10) || 'Grado: pre-K' || chr(10)
        when 3 then 'Escuela: ' || case when doc_id % 3 = 0 then 'and if anything' else '- Del  Sol .' end || chr(10) else '' end || body as text from a),
      f as (select *, {_GRADE} as grade, {_SCHOOL} as school_name, doc_id % 9 = 6 as template, substr({P.sql_trim("array_to_string(string_split(text, chr(10))[1:20], chr(10))")}, 1, 300) as head from t)
      select doc_id, grade, school_name, concat_ws(';', case when not template and grade is null then 'MISSING_GRADE' end, case when not template and school_name is null then 'MISSING_SCHOOL_NAME' end,
        case when doc_id % 5 = 0 then 'OCR_LOW_CONFIDENCE' end, case when template then 'TEMPLATE_ONLY' end) as codes, case when not template and grade is null then head end as grade_snippet,
        case when not template and school_name is null then '{V.TEXT_SOURCE}' end as school_source, case when not template and grade is null then {len(V.TEXT_GRADES)} end as grade_patterns from f""",
        T.PAGES,
    )
}
