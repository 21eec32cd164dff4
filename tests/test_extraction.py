"""Literal cases of the line extractors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmark.functions import fixed as V
from leafmark.functions import plausible as P
from leafmark.operators import lines as L


def value(spark, text, field, **flags):
    worded = L.solid(L.lines_of(F.col("t")))
    out = spark.createDataFrame([(text,)], "t string").select(L.near_label(worded, L.folded_all(worded), V.ALIASES[field], **flags).alias("v"))
    return out.first()["v"]


@pytest.mark.parametrize(
    ("text", "field", "flags", "want"),
    [
        ("Student's Name: Alva Brook", "student_name", {}, "Alva Brook"),
        ("Student\u2019s Name\n\nAlva Brook\nGrade", "student_name", {}, "Alva Brook"),
        ("Dina Drake\nSchool\nHill House", "school_name", {}, "Dina Drake"),
        ("Dina Drake\nSchool\nHill House", "school_name", {"value_after_label_only": True}, "Hill House"),
        ("Dina Drake\nSchool\nHill House", "school_name", {"same_line_only": True}, None),
        ("Nombre del Estudiante Alva Brook / Grado", "student_name", {}, "Alva Brook"),
        ("Nombre del Estudiante: Alva Brook / Grado", "student_name", {}, "Alva Brook / Grado"),
        ("School: the father figure", "school_name", {"same_line_only": True}, None),
        ("School\nSchool: Hill House", "school_name", {"same_line_only": True}, None),
        ("School\nSchool: Hill House", "school_name", {"same_line_only": True, "start": 1}, "Hill House"),
        ("nothing here", "school_name", {}, None),
    ],
)
def test_value_near_label(spark, text, field, flags, want):
    assert value(spark, text, field, **flags) == want


def test_canonical_schools(spark):
    rows = spark.createDataFrame([(v,) for v in ("Rachal  Carson", "EDWARD.", "Hill House", "ab", None)], "v string")
    shown, key = P.canon_name(F.col("v"))
    got = [tuple(r) for r in rows.select(shown.alias("a"), key.alias("b")).collect()]
    assert got == [("Rachel Carson Elementary School", "RACHEL_CARSON"), ("Edwards", "EDWARDS"), ("Hill House", None), (None, None), (None, None)]
