"""Text normalizers and predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import accents
from leafmark.functions import fixed as V
from leafmark.plans import tables as T

# Fixed values.
KINDER_POLICY = ("k", "kindergarten", "kinder", "pre-k", "prek", "pre-kindergarten")
KINDER_PIPELINE = ("k", "kinder", "kindergarten", "kinder.", "k-grade")
ACRONYMS = ("PS", "MS", "HS", "K", "PK")
HEADER_WORDS = ("student", "name", "grade", "grado", "school", "escuela", "teacher", "maestro", "maestra", "essay", "fatherhood", "illinois", "ifi")
RELAXED_WORDS = HEADER_WORDS + (
    "studnt", "studen", "studet", "garde", "grad", "grade", "schol", "schoo", "schol", "escue", "escuel", "essay", "fahter", "father", "illinois", "initiative",
)
VERBS = ("is", "are", "was", "were", "be", "have", "has", "do", "did", "will", "can", "write", "wrote")
#: The accents of the four languages of the test tables, for SQL.
ACCENTS_FROM, ACCENTS_TO = "àâäáãçèéêëìíîïñòóôöõùúûüýÿ’‘“”", "aaaaaceeeeiiiinooooouuuuyy''\"\""
ENUM = (
    "MISSING_STUDENT_NAME", "MISSING_GRADE", "MISSING_SCHOOL_NAME", "EMPTY_ESSAY", "SHORT_ESSAY", "OCR_LOW_CONFIDENCE", "EXTRACTION_FALLBACK_USED",
    "TEMPLATE_ONLY", "DOC_TYPE_UNKNOWN", "INVALID_GRADE_RANGE", "UNKNOWN_SCHOOL", "POSSIBLE_FIELD_SWAP", "CONTENT_MISMATCH", "BLANK_SUBMISSION",
)
SPACE = r"[\x09-\x0D\x20]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space at either end (ASCII, as everywhere here where results are compared across engines)."""
    return F.btrim(c, F.lit("\t\n\x0b\x0c\r "))


def norm_key(c: Column) -> Column:
    """Group key: trimmed, blanks collapsed, case folded; null is ''."""
    return F.replace(F.lower(F.regexp_replace(trimmed(F.coalesce(c, F.lit(""))), rf"{SPACE}+", " ")), F.lit("ß"), F.lit("ss"))


def norm_match(c: Column) -> Column:
    """Match text: case folded, anything but letters a-z and digits is one blank."""
    folded = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return trimmed(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def norm_accent(c: Column) -> Column:
    """Lower case without accents, with straight quotes: canonical decomposition less its marks, for all of Unicode."""
    return accents.plain(c)


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, rf"{SPACE}+"), "")


def capitalized(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def display_name(c: Column) -> Column:
    """Title case with acronyms kept and outer punctuation gone; null if fewer than three characters are left."""
    outer = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~\x09-\x0D\x20]+"""
    s = F.array_join(words(F.regexp_replace(trimmed(c), f"^{outer}|{outer}$", "")), " ")
    shown = F.array_join(F.transform(F.split(s, " "), lambda w: F.when(F.upper(w).isin(*ACRONYMS), F.upper(w)).otherwise(capitalized(w))), " ")
    return F.when(F.length(s) >= 3, shown)


def number(text: Column) -> Column:
    """The integer a match holds, null without one or beyond 18 digits."""
    return F.when(F.length(text).between(1, 18), text.try_cast("long"))


def grade_policy(c: Column) -> tuple[Column, Column]:
    """(grade, method) by the validation policy: K aliases, else the first integer if it is 1-12."""
    low = F.lower(trimmed(c))
    value = number(F.regexp_extract(low, r"(-?\d+)", 1))
    kinder = low.isin(*KINDER_POLICY)
    method = (
        F.when(c.isNull() | (low == ""), "missing")
        .when(kinder, "kindergarten_alias")
        .when(~low.rlike(r"\d"), "unparseable")
        .when(value.isNull() | ~value.between(1, 12), "invalid_range")
        .when(low == value.cast("string"), "numeric")
        .when(low.contains("grade"), "grade_prefix")
        .when(low.rlike(r"\d+(st|nd|rd|th)\b"), "ordinal")
        .otherwise("numeric_parse")
    )
    grade = F.when(kinder, "K").when(value.between(1, 12), value.cast("string"))
    return grade, method


def grade_pipeline(c: Column) -> tuple[Column, Column]:
    """(grade, reason) by the pipeline: the first pattern that gives 1-12; kindergarten has no number."""
    text = trimmed(c)
    found = [number(F.regexp_extract(text, p, 1)) for p in (r"(?i)grade[:\x09-\x0D\x20]*([0-9]{1,2})", r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?[\x09-\x0D\x20]*grade", r"^([0-9]{1,2})$")]
    value = F.coalesce(*[F.when(v.between(1, 12), v) for v in found])
    kinder = F.lower(text).isin(*KINDER_PIPELINE)
    reason = F.when(c.isNull(), "missing").when(text == "", "empty").when(kinder, "kinder").when(value.isNotNull(), "parsed").otherwise("unparsed")
    return F.when(~kinder, value), reason


def grade_gate(c: Column) -> Column:
    """1-12 or K, else null."""
    s = F.upper(trimmed(c))
    value = F.when(s.rlike(r"^[+-]?\d{1,9}$"), s.try_cast("long"))
    return F.when(F.lower(s).isin(*KINDER_PIPELINE), "K").when(value.between(1, 12), value.cast("string"))


def grade_parse(c: Column) -> Column:
    """A grade near its label: no years, no two-digit numbers above 12, at most four tokens."""
    token = r"[^\x09-\x0D\x20]+"

    def judge(text: Column) -> Column:
        kinder = text.rlike(rf"(?i)^(?:{SPACE}*{token}){{0,1}}{SPACE}*[^\x09-\x0D\x20]*k") & text.rlike(rf"^{token}(?:{SPACE}+{token})?$") | text.rlike(V.KINDER_PATTERN)
        single = F.regexp_extract(text, r"(?i)^([1-9]|1[0-2])(?:st|nd|rd|th)?$", 1)
        after = F.regexp_extract(text, r"(?i)(?:grade|grado)[ ]*[:\-/]?[ ]*([1-9]|1[0-2])(?:st|nd|rd|th)?\b", 1)
        before = F.regexp_extract(text, r"(?i)\b([1-9]|1[0-2])(?:st|nd|rd|th)?[ ]*(?:grade|grado)\b", 1)
        several = text.rlike(SPACE)
        usable = text.rlike(rf"^{token}(?:{SPACE}+{token}){{0,3}}$") & ~text.rlike(r"\b(?:19|20)\d{2}\b|\b(?:1[3-9]|[2-9]\d)\b")
        return F.when(usable, F.when(kinder, "K").otherwise(F.nullif(F.when(~several, single).otherwise(F.coalesce(F.nullif(after, F.lit("")), before)), F.lit(""))))

    return let(trimmed(c), judge)


def grade_extract(c: Column) -> Column:
    """The extractor's form: K, an ordinal, or the first number unless it is a year or above 12."""
    s = F.upper(trimmed(c))
    digits = F.regexp_extract(s, r"(\d+)", 1)
    value = number(digits)
    return F.when(s.isin("K", "KINDER", "KINDERGARTEN"), "K").when((F.length(digits) < 4) & value.between(1, 12), value.cast("string"))


def grade_admin(c: Column) -> Column:
    """The administrators' form: unknown text is kept, pre-kindergarten is its own value."""
    s = trimmed(c)
    value = number(F.regexp_extract(s, r"(\d+)", 1))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", None)
        .when(F.upper(s).isin("K", "KINDER", "KINDERGARTEN"), "K")
        .when(F.upper(s).isin("PRE-K", "PREK", "PRE-KINDERGARTEN"), "Pre-K")
        .when(value.between(1, 12), value.cast("string"))
        .otherwise(s)
    )


def grade_bulk(c: Column) -> Column:
    """The teachers' bulk form: pre-kindergarten is K, other text is kept as it is."""
    value = number(F.regexp_extract(c, r"(\d+)", 1))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(F.upper(c).isin("K", "KINDER", "KINDERGARTEN", "PRE-K", "PREK", "PRE-KINDERGARTEN"), "K").when(value.between(1, 12), value.cast("string")).otherwise(c)


ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12,
    "primero": 1, "segundo": 2, "tercero": 3, "cuarto": 4, "quinto": 5, "sexto": 6, "séptimo": 7, "octavo": 8, "noveno": 9, "décimo": 10,
}


def grade_words(c: Column) -> Column:
    """A grade in a free answer: ordinal digits, then ordinal words, then a number of one or two digits."""
    low = F.lower(trimmed(c))
    ordinal = number(F.regexp_extract(low, r"\b(\d{1,2})(?:st|nd|rd|th)\b", 1))
    word = F.coalesce(*[F.when(low.contains(w), F.lit(n)) for w, n in ORDINALS.items()]).cast("long")
    plain = number(F.regexp_extract(low, r"\b(\d{1,2})\b", 1))
    value = F.coalesce(ordinal, word, plain)
    return F.when(value.between(1, 12), value)


def quality_score(c: Column) -> Column:
    """0.8 of the share of letters and 0.2 of the share of alphanumerics among non-blank characters."""
    solid = F.length(F.regexp_replace(c, rf"{SPACE}+", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    score = F.try_divide(letters, solid) * 0.8 + (1 - F.try_divide(solid - alnum, solid)) * 0.2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def header_score(c: Column, relaxed: bool = False) -> Column:
    """Share of header keywords in a page; the relaxed list counts repeats and is capped at 1."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = sum((low.contains(w).cast("int") for w in (RELAXED_WORDS if relaxed else HEADER_WORDS)), F.lit(0))
    return F.least(F.lit(1.0), hits / float(len(HEADER_WORDS)))


def suspicious_name(c: Column) -> Column:
    """More than five words, a verb, or fewer than 40 % of the words with letters capitalized."""
    w = words(F.coalesce(c, F.lit("")))
    lettered = F.filter(w, lambda x: x.rlike(r"\p{L}"))
    verb = F.exists(w, lambda x: F.lower(F.regexp_replace(x, r"^[.,!?]+|[.,!?]+$", "")).isin(*VERBS))
    titled = F.size(F.filter(lettered, lambda x: x.rlike(r"^\p{Lu}")))
    return (F.size(w) > 5) | verb | F.coalesce(F.try_divide(titled, F.size(lettered)) < 0.4, F.lit(False))


def route_doc_type(has_form: Column, structure: Column, format: Column, layout: Column, score: Column, anchored: Column, text: Column) -> Column:
    """Document type by fixed priority."""
    scanned = format.isin("image_only", "hybrid")
    return (
        F.when(has_form, "ifi_typed_form_submission")
        .when(structure == "template", "template")
        .when((structure == "multi") & scanned, "bulk_scanned_batch")
        .when((layout == "ifi_official_scanned") | (scanned & (score >= 0.2)), "ifi_official_form_scanned")
        .when(layout == "ifi_official_typed", "ifi_official_form_filled")
        .when((format == "native_text") & (trimmed(F.coalesce(text, F.lit(""))) != "") & ~anchored, "standard_freeform_essay")
        .otherwise("unknown")
    )


def doc_class(format: Column, structure: Column, pages: Column, chunks: Column) -> Column:
    scanned = format.isin("image_only", "hybrid")
    return (
        F.when((structure == "multi") & (chunks > 1), "BULK_SCANNED_BATCH")
        .when((structure == "single") & (pages > 1), "MULTI_PAGE_SINGLE")
        .when((format == "native_text") & (pages == 1), "SINGLE_TYPED")
        .when(scanned & (pages == 1), "SINGLE_SCANNED")
        .when(format == "native_text", "SINGLE_TYPED")
        .otherwise("SINGLE_SCANNED")
    )


def doc_role(is_chunk: Column, is_parent: Column, structure: Column, cls: Column) -> Column:
    """A chunk is a document; parents, multi-entry files and bulk batches are containers."""
    return F.when(is_chunk, "document").when(is_parent | (structure == "multi") | (cls == "BULK_SCANNED_BATCH"), "container").otherwise("document")


LEGACY_TYPES = {"ifi_official_template_blank": "template", "essay_only": "standard_freeform_essay"}
POLICY_TYPES = T.DOC_TYPES[:8]


def doc_type_map(doc_type: Column, nested: Column, template: Column) -> Column:
    """Current name of a document type, from the record, the nested report, or the template flag."""
    given = F.coalesce(F.nullif(trimmed(doc_type), F.lit("")), F.nullif(trimmed(nested), F.lit("")))
    low = F.lower(given)
    known = F.coalesce(*[F.when(low == k, v) for k, v in LEGACY_TYPES.items()], F.when(low.isin(*POLICY_TYPES), low), F.lit("unknown"))
    return F.when(given.isNull() & template, "template").when(given.isNull(), "unknown").otherwise(known)


def codes_norm(c: Column, enum_only: bool = False, loose: bool = False) -> Column:
    """`;` text to sorted distinct codes; loose also splits on commas, raises case and drops placeholders."""
    text = F.upper(F.replace(c, F.lit(","), F.lit(";"))) if loose else c
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), trimmed), lambda x: x != "")
    if loose:
        parts = F.filter(parts, lambda x: ~x.isin("[]", "{}", "NULL"))
    if enum_only:
        parts = F.filter(parts, lambda x: x.isin(*ENUM))
    return F.array_sort(F.array_distinct(parts))


def codes_label(codes: Column) -> Column:
    """Codes as words: lower case with blanks, first letter raised, joined by bullets."""
    return F.array_join(F.transform(codes, lambda x: capitalized(F.lower(F.replace(x, F.lit("_"), F.lit(" "))))), " • ")


def pii_hash(c: Column, salt: str) -> Column:
    return F.when(trimmed(c) != "", F.sha2(F.concat(F.lit(salt + ":"), trimmed(c)), 256))


def conf_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 0.5, "low").when(c < 0.75, "medium").otherwise("high")


def name_from_file(c: Column) -> Column:
    """A name of two or three words in a file's stem, capitalized; plausible.name_from_file() tests it further."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    parts = F.filter(words(F.regexp_replace(stem, r"[_\-.]+", " ")), lambda w: ~F.lower(w).isin("essay", "final", "copy", "scan", "page", "draft", "the", "of") & ~w.rlike(r"\d"))
    return F.when(F.size(parts).between(2, 3), F.array_join(F.transform(parts, capitalized), " "))


def best_text(*sources: tuple[str, Column], last: tuple[str, Column] | None = None, least: int = 30) -> tuple[Column, Column]:
    """(text, label): the first source with enough words, else the first with any, else the last resort if it has any, else an empty one."""
    full = [(label, c, F.size(words(F.coalesce(c, F.lit(""))))) for label, c in (*sources, *([last] if last else []))]
    enough = full[: len(sources)]
    text = F.coalesce(*[F.when(n >= least, c) for _, c, n in enough], *[F.when(n > 0, c) for _, c, n in full], F.lit(""))
    label = F.coalesce(*[F.when(n >= least, F.lit(k)) for k, _, n in enough], *[F.when(n > 0, F.lit(k)) for k, _, n in full], F.lit("none"))
    return text, label


def emails(c: Column) -> tuple[Column, Column]:
    """(valid, invalid) e-mails of a list: lower case, in order, without repeats."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.lower(c), r"[,\n]+"), trimmed), lambda x: x != ""))
    good = r"^[^@\x09-\x0D\x20]+@[^@\x09-\x0D\x20]+\.[^@\x09-\x0D\x20]+$"
    return F.filter(parts, lambda x: x.rlike(good)), F.filter(parts, lambda x: ~x.rlike(good))


def snippet(c: Column, lines: int = 20, chars: int = 300) -> Column:
    return F.substring(F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n"), 1, chars)
