"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures of length, symbols, stop words and lines are column expressions over the whole text, and each row
of the rule table bounds one ratio of them; the verdict is one projection without user functions, joins
or shuffles. Words repeated in three-word windows are found inside the row: window hashes are
sorted with their positions, and neighbours that agree mark their windows. Rows without any repeated
window skip the sort.

Cases: a null text has no words and fails, as does an empty one; a ratio without a denominator is null and
passes its rule. Nothing depends on other rows: repeated rows get the same verdict, and null or repeated doc_ids pass through, as do further
columns of apply_rules(); those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is a that for was be on by with as it at or from this "
    "der die das und ist ein eine zu von mit für den im nicht auf "
    "le la les de des du et un une est que en pour dans sur "
    "el los las y del se por con una es para"
).split()

#: (rule, ratio of two measures, least, most); None leaves a side open.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 3.0, 10.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    ("marks_per_word", "n_marks", "n_words", None, 0.5),
    ("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    ("worded_share", "n_letter_words", "n_words", 0.8, None),
    ("repeated_line_share", "n_dup_lines", "n_lines", None, 0.4),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use, each over the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("__text", body).withColumn("__words", F.array_remove(F.split("__text", SPACE), ""))
    n = F.size("__words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(NOT_SPACE))
    read = split.withColumns({"__grams": grams, "__lines": lines})
    sorted_grams = F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = read.withColumn("__sorted", sorted_grams)
    neighbours = F.arrays_zip(F.slice("__sorted", 1, F.size("__sorted") - 1).alias("a"), F.slice("__sorted", 2, F.size("__sorted") - 1).alias("b"))
    equal = F.filter(neighbours, lambda p: p["a"]["h"] == p["b"]["h"])
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    marked = ordered.withColumn("__starts", starts)
    # Windows of three that start less than three apart share words.
    gaps = F.zip_with(F.slice("__starts", 1, F.size("__starts") - 1), F.slice("__starts", 2, F.size("__starts") - 1), lambda x, y: F.least(y - x, F.lit(3)))
    repeated = F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap))
    stop = F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))
    letters = F.filter("__words", lambda w: w.rlike(r"\p{L}"))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", "")),
        "n_marks": F.length("__text") - F.length(F.replace("__text", F.lit("!"), F.lit(""))),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_stop_words": F.size(stop),
        "n_letter_words": F.size(letters),
        "n_repeat_words": repeated,
    }
    return marked.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("__text", "__words", "__grams", "__lines", "__sorted", "__starts")


def verdict(rules=RULES) -> Column:
    """The names of the rules that a row of measures breaks."""

    def broken(over: str, under: str, least: float | None, most: float | None) -> Column:
        ratio = F.try_divide(over, under)
        out = F.lit(False)
        if least is not None:
            out = out | (ratio < least)
        if most is not None:
            out = out | (ratio > most)
        return out

    return F.array_compact(F.array(*[F.when(broken(*bounds), F.lit(name)) for name, *bounds in rules]))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with measures, base_failed, broken_rules and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("broken_rules", F.array_join(verdict(rules), ",")).withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*RESULT)


def _sql() -> str:
    def broken(name, over, under, least, most):
        ratio = f"({over} / nullif({under}, 0)::double)"
        tests = [f"{ratio} < {least}"] * (least is not None) + [f"{ratio} > {most}"] * (most is not None)
        return f"case when {' or '.join(tests)} then '{name}' end"

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, unnest(range(len(words) - 2)) as i, words from w where len(words) >= 3),
r as (select doc_id, i, count(*) over (partition by doc_id, words[i + 1], words[i + 2], words[i + 3]) as n from g),
c as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from r, (values (0), (1), (2)) t(k) where n > 1 group by 1),
m as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (length(text) - length(replace(text, '!', '')))::bigint as n_marks, len(lines)::bigint as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        len(list_filter(words, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\pL')))::bigint as n_letter_words,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join c on c.doc_id = w.doc_id),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
        concat_ws(',', {", ".join(broken(*r) for r in RULES)}) as broken_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and broken_rules = '' as kept, broken_rules from v
"""


OP6_SQL = _sql()
