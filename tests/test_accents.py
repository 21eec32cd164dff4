"""Accent folding against Python's own decomposition, on every code point and on sequences."""

from __future__ import annotations

import random
import unicodedata

from conftest import SF
from pyspark.sql import functions as F

from leafmark import registry
from leafmark.functions import accents
from leafmark.functions import text as X
from leafmark.operators import lines


def by_definition(text):
    """Lower case, decomposed, without non-spacing marks, with straight quotes."""
    for curly, straight in accents.QUOTES.items():
        text = text.replace(curly, straight)
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def folded(spark, texts, use=X.norm_accent):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["p"] for r in rows.select("i", use(F.col("t")).alias("p")).orderBy("i").collect()]


def test_every_character(spark):
    """A thousand characters a row; those whose lower case the two sides know differently are left out, and are few."""
    points = [chr(p) for p in range(0x30000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    points += [chr(p) for p in range(0xE0100, 0xE01F0)]
    lower = folded(spark, points, F.lower)
    known = [c for c, low in zip(points, lower, strict=True) if low == c.lower()]
    assert len(known) > 0.999 * len(points) and len(known) > 140_000
    texts = ["|".join(known[i : i + 1000]) for i in range(0, len(known), 1000)]
    for got, text in zip(folded(spark, texts), texts, strict=True):
        assert got == "|".join(by_definition(c) for c in text.split("|")) or "|" in text.replace("|", "", 999)


def test_sequences(spark):
    r = random.Random(6)
    letters = "aeounAEOUNÉßçǪ각힣나𝅗𑂚’“ Straße" + "̧̣́̈̄⃐️"
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(500)] + ["Teléfono", "ＡＢ", "Ệ", "İstanbul", "plain", "", "ŉ ﬁ ½ Ⅻ"]
    assert folded(spark, texts) == [by_definition(t) for t in texts]
    assert folded(spark, [None]) == [None]


def test_simple_is_accentless_for_literals(spark):
    texts = ["Teléfono", "nombre del niño", "ÉCOLE", "“x”", "é", "각"]
    assert folded(spark, texts, accents.accentless) == [accents.simple(t) for t in texts]


def test_labels_are_found_in_decomposed_text(spark):
    text = "Nombre del Estudiante: Ana Luz\nEscuela: Oak Hill School\nGrado: 5\nTeléfono: 312 555 0100\n"
    rows = [(0, text), (1, unicodedata.normalize("NFD", text)), (2, text.replace("é", "ẹ́"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", lines.lines_of(F.col("text")))
    near = {field: lines.near_label(F.col("lines"), lines.folded_all(F.col("lines")), (alias,)) for field, alias in (("name", "nombre del estudiante"), ("phone", "teléfono"), ("grade", "grado"))}
    got = docs.select("doc_id", *[c.alias(f) for f, c in near.items()]).orderBy("doc_id").collect()
    assert len({tuple(r)[1:] for r in got}) == 1 and got[1]["phone"] is not None and got[1]["name"] == "Ana Luz"
    keys = folded(spark, [t for _, t in rows])
    assert len(set(keys)) == 1 and "telefono" in keys[0]


def test_query_on_documents(spark, duck, same):
    for name in ("norm_accent", "norm_accent_marks"):
        same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))
