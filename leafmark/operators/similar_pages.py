"""Attribution by similarity, for values that no page holds literally.

The Arrow function sees only pairs of a value and a page of its range that the exact tiers have left.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leafmark.functions import text as X
from leafmark.operators import pages as P
from leafmark.plans import tables as T


@F.pandas_udf(DoubleType())
def best_line_ratio(needle: pd.Series, page: pd.Series) -> pd.Series:
    """The highest difflib ratio of a normalized value and a page's normalized lines."""

    def best(value: str, text: str) -> float:
        ratios = [0.0]
        for line in (text or "").splitlines():
            plain = re.sub(r"[^a-z0-9]+", " ", line.lower().replace("ß", "ss")).strip()
            # The lengths alone can rule a line out.
            if plain and 2 * min(len(plain), len(value)) > max(ratios) * (len(plain) + len(value)):
                ratios.append(SequenceMatcher(None, value, plain).ratio())
        return max(ratios)

    return pd.Series([best(a, b) if a else 0.0 for a, b in zip(needle, page, strict=True)], dtype="float64")


def confidence(ratio: Column) -> Column:
    """0.85 to 0.95 for ratios from 0.92, 0.70 to 0.85 from 0.85, null below."""
    high = F.least(F.lit(0.95), F.greatest(F.lit(0.85), 0.85 + (ratio - 0.92) / 0.08 * 0.10))
    low = F.least(F.lit(0.85), F.greatest(F.lit(0.70), 0.70 + (ratio - 0.85) / 0.07 * 0.15))
    return F.when(ratio >= 0.92, F.bround(high, 6)).when(ratio >= 0.85, F.bround(low, 6))


def _scored(fields: DataFrame, pages: DataFrame) -> DataFrame:
    rows = fields.join(pages.select("doc_id", "page_index", "text"), "doc_id").where(F.col("page_index").between(F.col("start_page"), F.col("end_page")))
    return rows.withColumn("ratio", best_line_ratio(X.norm_match(F.col("value")), F.col("text")))


def attributed(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """As the plain attribution, but a page before it that is similar enough comes first, and pages count for values found nowhere."""
    plain = P.attributed(fields, pages)
    # Only pages before the literal hit can still win.
    open_rows = fields.drop("end_page").join(plain.select("doc_id", "field", "end_page", F.col("page_index").alias("__hit")), ["doc_id", "field"]).withColumn("end_page", F.coalesce(F.col("__hit") - 1, "end_page")).drop("__hit")
    near = _scored(open_rows, pages).withColumn("c", confidence(F.col("ratio"))).where("c is not null")
    first = near.groupBy("doc_id", "field").agg(F.min_by(F.struct(F.col("page_index").alias("p"), "c"), "page_index").alias("n"))
    both = plain.join(first, ["doc_id", "field"], "left")
    won = F.col("n").isNotNull()
    return both.select(
        "doc_id", "field", "value", F.when(won, F.col("n.p")).otherwise(F.col("page_index")).alias("page_index"),
        F.when(won, F.col("n.c")).otherwise(F.col("confidence")).alias("confidence"), F.when(won, "fuzzy_match").otherwise(F.col("method")).alias("method"),
    )


def candidates(fields: DataFrame, pages: DataFrame, k: int = 3) -> DataFrame:
    """The k pages most similar to each value that has no page, with a snippet."""
    lost = attributed(fields, pages).where("page_index is null").select("doc_id", "field")
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("ratio"), "page_index")
    scored = _scored(fields.join(lost, ["doc_id", "field"], "left_semi"), pages)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("doc_id", "field", "place", "page_index", F.bround("ratio", 6).alias("score"), F.substring("text", 1, 200).alias("snippet"))


QUERIES = {
    "attr_fuzzy": lambda s, d: attributed(P._fields(s, d), T.pages(s, d)),
    "attr_topk": lambda s, d: candidates(P._fields(s, d), T.pages(s, d)),
}

ORACLE: dict[str, str] = {}
