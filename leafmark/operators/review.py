"""The validation rule set, approval gates, review filters and edits of records.

All rules of a record are columns of one projection; the policy table has eight rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.plans import tables as T

# doc_type, needs the three fields, least words, essay wanted, floor of OCR confidence, fallback goes to review.
POLICIES = (
    ("ifi_typed_form_submission", True, 50, True, None, True),
    ("ifi_official_form_scanned", True, 50, True, 0.5, True),
    ("ifi_official_form_filled", True, 50, True, None, True),
    ("essay_with_header_metadata", True, 50, True, None, True),
    ("standard_freeform_essay", True, 50, True, None, False),
    ("bulk_scanned_batch", False, 0, False, None, False),
    ("template", True, 0, False, None, False),
    ("unknown", True, 50, True, None, True),
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ESSAY_MARKERS = ("my father", "my mother", "another example", "because", "paragraph", "hard working")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES), "policy string, needs_fields boolean, min_words int, needs_essay boolean, ocr_floor double, review_fallback boolean")


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike("|".join(parts))


def sanitized(c: Column) -> Column:
    """Without leading noise; null for what reads as a date or page header."""

    def kept(s: Column) -> Column:
        def header(low: Column) -> Column:
            dated = any_of(low, WEEKDAYS) & (any_of(low, MONTHS) | low.rlike(r"\b\d{4}\b"))
            return low.rlike(r"\bpage +\d+\b") | dated | low.isin("ifi", "i said", "initiative", "illinois", "english page 2")

        return F.when((s != "") & ~X.let(F.lower(s), header), s)

    return X.let(X.trimmed(F.regexp_replace(X.trimmed(c), r"^[^A-Za-z0-9]+", "")), kept)


def missing_name(c: Column) -> Column:
    def missing(s: Column) -> Column:
        low = F.lower(s)
        label = any_of(low, ("father/father-figure name", "nombre deo padre", "figura paterna", "student's name", "nombre del estudiante")) | (low == "judging process")
        return s.isNull() | (F.length(s) < 2) | label | (F.length(s) > 60) | (F.size(X.words(s)) > 5) | s.rlike(r"[.!?;:]")

    return X.let(F.regexp_replace(sanitized(c), r"[.,;:]+$", ""), missing)


def missing_school(c: Column) -> Column:
    def missing(s: Column) -> Column:
        low = F.lower(s)
        essay = s.contains("\n") | (F.length(s) > 80) | (F.size(X.words(s)) > 8) | s.rlike(r"[.!?;:]") | any_of(low, ESSAY_MARKERS)
        return s.isNull() | (F.length(s) < 3) | low.isin("escuela", "/ escuela", "school", "school name") | low.contains("a dog") | essay

    return X.let(sanitized(c), missing)


def with_policy(records: DataFrame) -> DataFrame:
    """records with doc_role and their policy. Children of a bulk batch are held to the policy of unknown documents."""
    mapped = records.withColumn("doc_type", X.doc_type_map(F.col("doc_type"), F.lit(None).cast("string"), F.lit(False))).withColumn(
        "doc_role", X.doc_role(F.col("is_chunk"), F.col("is_container_parent"), F.lit(""), F.col("doc_class"))
    )
    name = F.when((F.col("doc_type") == "bulk_scanned_batch") & (F.col("doc_role") == "document"), "unknown").otherwise(F.col("doc_type"))
    joined = mapped.withColumn("policy", name).join(F.broadcast(policies(records.sparkSession)), "policy")
    floor = F.when((F.col("policy") == "unknown") & F.col("format").isin("image_only", "hybrid"), 0.5).otherwise(F.col("ocr_floor"))
    return joined.withColumn("ocr_floor", floor)


def validate(records: DataFrame, reference: DataFrame) -> DataFrame:
    """records with codes: sorted reason codes by their policy; containers have none.

    reference: school_key, the normalized names of known schools, joined on equality.
    """
    known = reference.select("school_key", F.lit(True).alias("__known")).distinct()
    rows = with_policy(records).withColumn("school_key", X.norm_match(sanitized(F.col("school_name")))).join(known, "school_key", "left")
    c = F.col
    template, document = c("doc_type") == "template", c("doc_role") == "document"
    no_name, no_school = c("needs_fields") & missing_name(c("student_name")), c("needs_fields") & missing_school(c("school_name"))
    no_grade = c("needs_fields") & (F.coalesce(X.trimmed(c("grade")), F.lit("")) == "")
    grade, _ = X.grade_policy(c("grade"))
    low = c("ocr_confidence_avg") < c("ocr_floor")
    rules = {
        "CONTENT_MISMATCH": (c("doc_type") == "unknown") & no_school & no_grade & (c("word_count") <= 12),
        "DOC_TYPE_UNKNOWN": c("doc_type") == "unknown",
        "EMPTY_ESSAY": ~template & c("needs_essay") & (c("word_count") == 0),
        "EXTRACTION_FALLBACK_USED": ~template & (c("extraction_method") == "fallback") & c("review_fallback"),
        "INVALID_GRADE_RANGE": c("needs_fields") & ~no_grade & grade.isNull(),
        "MISSING_GRADE": no_grade,
        "MISSING_SCHOOL_NAME": no_school,
        "MISSING_STUDENT_NAME": no_name,
        "OCR_LOW_CONFIDENCE": ~template & c("format").isin("image_only", "hybrid") & F.coalesce(low, F.lit(False)),
        "POSSIBLE_FIELD_SWAP": ~template & F.coalesce(X.norm_key(sanitized(c("student_name"))) == X.norm_key(sanitized(c("school_name"))), F.lit(False)) & sanitized(c("student_name")).isNotNull() & sanitized(c("school_name")).isNotNull(),
        "SHORT_ESSAY": ~template & c("needs_essay") & c("word_count").between(1, c("min_words") - 1),
        "TEMPLATE_ONLY": template,
        "UNKNOWN_SCHOOL": ~template & c("needs_fields") & ~missing_school(c("school_name")) & c("__known").isNull(),
    }
    codes = F.array_compact(F.array(*[F.when(document & rule, code) for code, rule in sorted(rules.items())]))
    return rows.withColumn("codes", F.array_join(codes, ";")).withColumn("review", c("codes") != "")


def approval(records: DataFrame) -> DataFrame:
    """records with missing (fields that stand against approval, in order), can_approve and auto_approve."""
    c = F.col
    grade, _ = X.grade_policy(c("grade"))
    document = c("doc_role") == "document"
    missing = F.array_compact(
        F.array(
            F.when(c("needs_fields") & missing_name(c("student_name")), "student_name"),
            F.when(c("needs_fields") & missing_school(c("school_name")), "school_name"),
            F.when(c("needs_fields") & grade.isNull(), "grade"),
            F.when(c("needs_essay") & (c("word_count") == 0), "word_count"),
            F.when(c("needs_essay") & c("word_count").between(1, c("min_words") - 1), "short_essay"),
            F.when(c("ocr_confidence_avg") < c("ocr_floor"), "ocr_low_confidence"),
        )
    )
    auto = document & (c("review_reason_codes") == "") & ~(c("review_fallback") & (c("extraction_method") == "fallback"))
    rows = with_policy(records).withColumn("missing", F.when(document, F.array_join(missing, ";")).otherwise(""))
    return rows.withColumn("can_approve", c("missing") == "").withColumn("auto_approve", auto)


def invariant_violations(validated: DataFrame) -> DataFrame:
    """How many records need review without codes or the other way round."""
    return validated.agg(F.count_if(F.col("review") != (F.col("codes") != "")).alias("violations"), F.count("*").alias("records"))


def codes_sync(codes: Column, wanted: dict[str, Column]) -> Column:
    """Codes with the wanted ones discarded and added again where their condition holds, sorted."""
    drop = F.array(*[F.lit(k) for k in wanted])
    add = F.array_compact(F.array(*[F.when(v, k) for k, v in wanted.items()]))
    return F.array_sort(F.array_union(F.array_except(codes, drop), add))


def bulk_edit(records: DataFrame, selected: DataFrame, **values: Column) -> DataFrame:
    """records with values set on the selected ids, and MISSING_* codes brought in line on those."""
    marked = records.join(selected.select("submission_id", F.lit(True).alias("__on")).distinct(), "submission_id", "left")
    on = F.coalesce("__on", F.lit(False))
    edited = marked.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in values.items()})
    wanted = {
        "MISSING_GRADE": X.grade_policy(F.col("grade"))[0].isNull(),
        "MISSING_SCHOOL_NAME": missing_school(F.col("school_name")),
        "MISSING_STUDENT_NAME": missing_name(F.col("student_name")),
    }
    synced = F.array_join(codes_sync(X.codes_norm(F.col("review_reason_codes")), wanted), ";")
    out = edited.withColumn("review_reason_codes", F.when(on, synced).otherwise(F.col("review_reason_codes")))
    return out.withColumn("needs_review", F.when(on, F.col("review_reason_codes") != "").otherwise(F.col("needs_review"))).drop("__on")


def bulk_rename(records: DataFrame, field: str, old: str, new: str) -> DataFrame:
    return records.withColumn(field, F.when(F.col(field) == old, new).otherwise(F.col(field)))


def bulk_to_review(records: DataFrame, selected: DataFrame) -> DataFrame:
    """records with needs_review set on the selected ids; codes stay."""
    marked = records.join(selected.select("submission_id", F.lit(True).alias("__on")).distinct(), "submission_id", "left")
    return marked.withColumn("needs_review", F.coalesce("__on", "needs_review")).drop("__on")


def review_repair(records: DataFrame) -> DataFrame:
    """The records whose stored review state is repaired, with new state and action.

    In review without codes: approved if nothing is missing, else given codes for what is; approved but lacking a field: back to review.
    """
    rows = approval(records)
    blank = F.col("needs_review") & (F.col("review_reason_codes") == "")
    lacking = ~F.col("needs_review") & F.col("missing").rlike("student_name|school_name|grade")
    action = F.when(blank & F.col("can_approve"), "approve").when(blank, "explain").when(lacking, "reopen")
    return rows.withColumn("action", action).where("action is not null").select("doc_id", "action", "missing", (F.col("action") != "approve").alias("needs_review"))


def force_approve(records: DataFrame) -> DataFrame:
    """Whether administrators may approve without regard to the essay: the three fields must be there."""
    missing = F.array_compact(
        F.array(
            F.when(missing_name(F.col("student_name")), "student_name"),
            F.when(missing_school(F.col("school_name")), "school_name"),
            F.when(X.grade_policy(F.col("grade"))[0].isNull(), "grade"),
        )
    )
    return records.select("doc_id", F.array_join(missing, ";").alias("missing"), (F.size(missing) == 0).alias("approved"))


def enum_check(records: DataFrame) -> DataFrame:
    """Codes outside the enum or with an equals sign, and codes counted more often than there are documents."""
    spark = records.sparkSession
    codes = records.select("doc_id", F.explode(X.codes_norm(F.col("review_reason_codes"))).alias("code"))
    counts = codes.groupBy("code").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(c,) for c in X.ENUM], "code string")
    return counts.join(F.broadcast(known), "code", "left_anti")


def expectations(validated: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected codes that a record lacks."""
    joined = expected.join(validated.select("doc_id", "codes"), "doc_id", "left")
    return joined.where(~F.coalesce(F.array_contains(F.split("codes", ";"), F.col("code")), F.lit(False))).select("doc_id", "code")


# Filters.


def filter_dashboard(records: DataFrame, school: str | None = None, grade: str | None = None, status: str | None = None) -> DataFrame:
    """Records by normalized school, grade and review state."""
    out = records
    if school is not None:
        out = out.where(X.norm_key(F.col("school_name")) == X.norm_key(F.lit(school)))
    if grade is not None:
        out = out.where(X.norm_key(F.col("grade")) == X.norm_key(F.lit(grade)))
    if status is not None:
        out = out.where(F.col("needs_review") == (status == "needs_review"))
    return out


MISSING = "__missing__"


def filter_review(records: DataFrame, reason: str | None = None, **fields: str) -> DataFrame:
    """Records in review by fields (MISSING: blank) and by a part of their codes' text."""
    out = records.where("needs_review")
    for name, value in fields.items():
        blank = F.coalesce(F.col(name), F.lit("")) == ""
        out = out.where(blank if value == MISSING else F.col(name) == value)
    return out.where(F.col("review_reason_codes").contains(reason)) if reason else out


def is_excluded(codes: str = "review_reason_codes") -> Column:
    return F.arrays_overlap(F.split(F.col(codes), ";"), F.array(F.lit("CONTENT_MISMATCH"), F.lit("BLANK_SUBMISSION")))


def multi_entry(records: DataFrame, everything: DataFrame) -> DataFrame:
    """Records whose file name occurs more than once among all rows."""
    names = everything.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1")
    return records.join(names, "filename", "left_semi")


def fingerprint() -> Column:
    """What makes two records the same entry: normalized student, school, grade and file."""
    return F.concat_ws("|", *[X.norm_key(F.col(c)) for c in ("student_name", "school_name", "grade")])


def dup_eligible() -> Column:
    """Chunks, children, containers and rows without a file are not looked at for duplicates."""
    return ~F.col("is_chunk") & F.col("parent_submission_id").isNull() & ~F.col("is_container_parent") & (F.coalesce("filename", F.lit("")) != "")


def dups_only(records: DataFrame) -> DataFrame:
    """Eligible records that share their fingerprint; counted by a partial aggregation, so a common one is no hot window."""
    rows = records.where(dup_eligible()).withColumn("fingerprint", fingerprint())
    return rows.join(rows.groupBy("fingerprint").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "fingerprint", "left_semi")


def approvable(records: DataFrame, grade: str | None = None) -> DataFrame:
    """Records in review that lack nothing and have no code but PENDING_REVIEW."""
    filled = [F.coalesce(X.trimmed(F.col(c)), F.lit("")) != "" for c in ("student_name", "school_name", "grade")]
    out = records.where(F.col("needs_review") & filled[0] & filled[1] & filled[2] & F.col("review_reason_codes").isin("", "PENDING_REVIEW"))
    return out.where(F.col("grade") == grade) if grade else out


def row_status() -> dict[str, Column]:
    """Three rules of display, which differ for rows in review without codes."""
    codes, review = F.col("review_reason_codes") != "", F.col("needs_review")
    return {
        "dashboard": F.when(review | codes, "needs_review").otherwise("approved"),
        "filter": F.when(review, "needs_review").otherwise("approved"),
        "assignment": F.when(codes, "needs_review").otherwise("approved"),
    }


KEYS = ("doc_id", "submission_id")


def _reference(s, d):
    return s.createDataFrame([(v,) for v in T.SCHOOLS.values()], "name string").where("name not like 'Ecole%'").select(X.norm_match(F.col("name")).alias("school_key"))


def _validated(s, d):
    return validate(T.submissions(s, d), _reference(s, d))


def _some(s, d):
    return T.submissions(s, d).where("doc_id % 7 = 3").select("submission_id")


def _expected(s, d):
    return T.submissions(s, d).where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "MISSING_GRADE").otherwise("TEMPLATE_ONLY").alias("code"))


def _ids(f):
    return lambda s, d: f(T.submissions(s, d)).select(*KEYS)


QUERIES = {
    "policy_join": lambda s, d: with_policy(T.submissions(s, d)).select("doc_id", "policy", "doc_role", "needs_fields", "min_words", "ocr_floor"),
    "validate": lambda s, d: _validated(s, d).select("doc_id", "codes", "review"),
    "validate_invariant": lambda s, d: invariant_violations(_validated(s, d)),
    "can_approve": lambda s, d: approval(T.submissions(s, d)).select("doc_id", "missing", "can_approve"),
    "auto_approve": lambda s, d: approval(T.submissions(s, d)).select("doc_id", "auto_approve"),
    "missing_preds": lambda s, d: T.submissions(s, d).select("doc_id", missing_name(F.col("student_name")).alias("name"), missing_school(F.col("school_name")).alias("school")),
    "sanitize_fields": lambda s, d: T.submissions(s, d).select("doc_id", sanitized(F.concat(F.lit("-- "), "student_name")).alias("name"), sanitized(F.when(F.col("doc_id") % 5 == 0, F.lit("Monday, May 4")).otherwise(F.col("school_name"))).alias("school")),
    "field_swap": lambda s, d: T.submissions(s, d).select("doc_id", F.coalesce(X.norm_key(F.col("student_name")) == X.norm_key(F.col("school_name")), F.lit(False)).alias("same")),
    "review_repair": lambda s, d: review_repair(T.submissions(s, d)),
    "codes_sync": lambda s, d: T.submissions(s, d).select(
        "doc_id", F.array_join(codes_sync(X.codes_norm(F.col("review_reason_codes")), {"MISSING_GRADE": F.col("doc_id") % 3 == 0, "MISSING_SCHOOL_NAME": F.col("school_name").isNull()}), ";").alias("codes")
    ),
    "bulk_edit": lambda s, d: bulk_edit(T.submissions(s, d), _some(s, d), grade=F.lit("6"), school_name=F.lit("Hilltop School")).select(*KEYS, "grade", "school_name", "needs_review", "review_reason_codes"),
    "bulk_rename": lambda s, d: bulk_rename(T.submissions(s, d), "school_name", "Lindenhof Schule", "Lindenhof").select(*KEYS, "school_name"),
    "bulk_to_review": lambda s, d: bulk_to_review(T.submissions(s, d), _some(s, d)).select(*KEYS, "needs_review"),
    "force_approve": lambda s, d: force_approve(T.submissions(s, d)),
    "enum_check": lambda s, d: enum_check(T.submissions(s, d)),
    "expectations": lambda s, d: expectations(_validated(s, d), _expected(s, d)),
    "filter_dashboard": _ids(lambda r: filter_dashboard(r, school="lindenhof schule", status="approved")),
    "filter_review": _ids(lambda r: filter_review(r, reason="MISSING_", school_name=MISSING)),
    "filter_excluded": _ids(lambda r: r.where(~is_excluded())),
    "multi_entry": _ids(lambda r: multi_entry(r.where("needs_review"), r)),
    "dup_eligible": _ids(lambda r: r.where(dup_eligible())),
    "dups_only": lambda s, d: dups_only(T.submissions(s, d)).select(*KEYS, "fingerprint"),
    "approvable": _ids(approvable),
    "row_status": lambda s, d: T.submissions(s, d).select("doc_id", *[v.alias(k) for k, v in row_status().items()]),
    "age_filter": _ids(lambda r: r.where(F.col("created_at") < F.lit("2024-01-01 10:00:00").cast("timestamp"))),
    "dashboard_scan": lambda s, d: dups_only(multi_entry(filter_dashboard(T.submissions(s, d).where(~is_excluded()), status="approved"), T.submissions(s, d))).orderBy(F.desc("created_at"), "doc_id").select(*KEYS, "fingerprint"),
}

W = r"[\x09-\x0D\x20]"


def _trim(c):
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def _or(c, parts):
    return f"regexp_matches({c}, '{'|'.join(p.replace(chr(39), chr(39) * 2) for p in parts)}')"


_low = "lower(x)"
_SAN = f"""(select case when x <> '' and not (regexp_matches({_low}, '\\bpage +\\d+\\b') or ({_or(_low, WEEKDAYS)} and ({_or(_low, MONTHS)} or regexp_matches({_low}, '\\b\\d{{{{4}}}}\\b')))
  or {_low} in ('ifi', 'i said', 'initiative', 'illinois', 'english page 2')) then x end from (select {_trim("regexp_replace(" + _trim("{0}") + ", '^[^A-Za-z0-9]+', '')")} as x))"""
_KEY = f"replace(lower(regexp_replace({_trim('coalesce({0}, {1})')}, '{W}+', ' ', 'g')), 'ß', 'ss')"


def _nk(c):
    return _KEY.format(c, "''")


_GRADE = rf"(select case when g in ({', '.join(repr(k) for k in X.KINDER_POLICY)}) then 'K' when v between 1 and 12 then v::varchar end from (select g, try_cast(nullif(regexp_extract(g, '(-?\d+)', 1), '') as bigint) as v from (select lower({_trim('grade')}) as g)))"
CHECKED = rf"""
san as (select *, {_SAN.format("student_name")} as name_s, {_SAN.format("school_name")} as school_s, {_GRADE} as grade_n,
  case when doc_type = 'essay_only' then 'standard_freeform_essay' else doc_type end as type_n,
  case when is_chunk then 'document' when is_container_parent or doc_class = 'BULK_SCANNED_BATCH' then 'container' else 'document' end as doc_role from submissions),
policied as (select *, case when type_n = 'bulk_scanned_batch' and doc_role = 'document' then 'unknown' else type_n end as policy, regexp_replace(name_s, '[.,;:]+$', '') as n from san),
checked as (select *, policy <> 'bulk_scanned_batch' as needs_fields, case when policy in ('bulk_scanned_batch', 'template') then 0 else 50 end::int as min_words, policy not in ('bulk_scanned_batch', 'template') as needs_essay,
  case when policy = 'ifi_official_form_scanned' or (policy = 'unknown' and format in ('image_only', 'hybrid')) then 0.5::double end as ocr_floor,
  policy not in ('bulk_scanned_batch', 'template', 'standard_freeform_essay') as review_fallback,
  n is null or length(n) < 2 or {_or("lower(n)", ("father/father-figure name", "nombre deo padre", "figura paterna", "student's name", "nombre del estudiante"))} or lower(n) = 'judging process' or length(n) > 60
    or len(list_filter(regexp_split_to_array(n, '{W}+'), lambda x: x <> '')) > 5 or regexp_matches(n, '[.!?;:]') as no_name,
  school_s is null or length(school_s) < 3 or lower(school_s) in ('escuela', '/ escuela', 'school', 'school name') or contains(lower(school_s), 'a dog') or contains(school_s, chr(10)) or length(school_s) > 80
    or len(list_filter(regexp_split_to_array(school_s, '{W}+'), lambda x: x <> '')) > 8 or regexp_matches(school_s, '[.!?;:]') or {_or("lower(school_s)", ESSAY_MARKERS)} as no_school,
  coalesce({_trim("grade")}, '') = '' as no_grade from policied),
missed as (select *, case when doc_role = 'document' then concat_ws(';', case when needs_fields and no_name then 'student_name' end, case when needs_fields and no_school then 'school_name' end,
  case when needs_fields and grade_n is null then 'grade' end, case when needs_essay and word_count = 0 then 'word_count' end, case when needs_essay and word_count between 1 and min_words - 1 then 'short_essay' end,
  case when ocr_confidence_avg < ocr_floor then 'ocr_low_confidence' end) else '' end as missing from checked),
validated as (select *, case when doc_role = 'document' then concat_ws(';',
  case when type_n = 'unknown' and no_school and no_grade and word_count <= 12 then 'CONTENT_MISMATCH' end, case when type_n = 'unknown' then 'DOC_TYPE_UNKNOWN' end,
  case when type_n <> 'template' and needs_essay and word_count = 0 then 'EMPTY_ESSAY' end, case when type_n <> 'template' and extraction_method = 'fallback' and review_fallback then 'EXTRACTION_FALLBACK_USED' end,
  case when needs_fields and not no_grade and grade_n is null then 'INVALID_GRADE_RANGE' end, case when needs_fields and no_grade then 'MISSING_GRADE' end,
  case when needs_fields and no_school then 'MISSING_SCHOOL_NAME' end, case when needs_fields and no_name then 'MISSING_STUDENT_NAME' end,
  case when type_n <> 'template' and format in ('image_only', 'hybrid') and ocr_confidence_avg < ocr_floor then 'OCR_LOW_CONFIDENCE' end,
  case when type_n <> 'template' and name_s is not null and school_s is not null and {_nk("name_s")} = {_nk("school_s")} then 'POSSIBLE_FIELD_SWAP' end,
  case when type_n <> 'template' and needs_essay and word_count between 1 and min_words - 1 then 'SHORT_ESSAY' end, case when type_n = 'template' then 'TEMPLATE_ONLY' end,
  case when type_n <> 'template' and needs_fields and not no_school and trim(regexp_replace(lower(school_s), '[^a-z0-9]+', ' ', 'g')) not in ('north ridge elementary', 'lindenhof schule', 'escuela del sol') then 'UNKNOWN_SCHOOL' end)
  else '' end as codes from missed)
"""
_S, _V = (T.SUBMISSIONS,), (T.SUBMISSIONS, CHECKED)
_IDS = "select doc_id, submission_id from submissions where "
_FP = f"concat_ws('|', {_nk('student_name')}, {_nk('school_name')}, {_nk('grade')})"
_ELIGIBLE = "not is_chunk and parent_submission_id is null and not is_container_parent and coalesce(filename, '') <> ''"
_ON = "submission_id in (select submission_id from submissions where doc_id % 7 = 3)"
ORACLE = {
    "policy_join": T.sql("select doc_id, policy, doc_role, needs_fields, min_words, ocr_floor from checked", *_V),
    "validate": T.sql("select doc_id, codes, codes <> '' as review from validated", *_V),
    "validate_invariant": T.sql("select 0::bigint as violations, count(*)::bigint as records from validated", *_V),
    "can_approve": T.sql("select doc_id, missing, missing = '' as can_approve from missed", T.SUBMISSIONS, CHECKED),
    "auto_approve": T.sql("select doc_id, doc_role = 'document' and review_reason_codes = '' and not (review_fallback and extraction_method = 'fallback') as auto_approve from checked", *_V),
    "missing_preds": T.sql("select doc_id, no_name as name, no_school as school from checked", *_V),
    "sanitize_fields": T.sql(f"t as (select doc_id, '-- ' || student_name as a, case when doc_id % 5 = 0 then 'Monday, May 4' else school_name end as b from submissions) select doc_id, {_SAN.format('a')} as name, {_SAN.format('b')} as school from t", *_S),
    "field_swap": T.sql(f"select doc_id, {_nk('student_name')} = {_nk('school_name')} as same from submissions", *_S),
    "review_repair": T.sql("""a as (select *, case when needs_review and review_reason_codes = '' and missing = '' then 'approve' when needs_review and review_reason_codes = '' then 'explain'
      when not needs_review and regexp_matches(missing, 'student_name|school_name|grade') then 'reopen' end as action from missed) select doc_id, action, missing, action <> 'approve' as needs_review from a where action is not null""", *_V),
    "codes_sync": T.sql("""select doc_id, array_to_string(list_sort(list_concat(list_filter(list_distinct(string_split(review_reason_codes, ';')), lambda x: x not in ('', 'MISSING_GRADE', 'MISSING_SCHOOL_NAME')),
      case when doc_id % 3 = 0 then ['MISSING_GRADE'] else [] end, case when school_name is null then ['MISSING_SCHOOL_NAME'] else [] end)), ';') as codes from submissions""", T.SUBMISSIONS),
    "bulk_edit": T.sql(f"""e as (select *, {_ON} as on_it from checked), c as (select *, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(review_reason_codes, ';'),
        lambda x: x not in ('', 'MISSING_GRADE', 'MISSING_SCHOOL_NAME', 'MISSING_STUDENT_NAME')), case when no_name then ['MISSING_STUDENT_NAME'] else [] end))), ';') as synced from e)
      select doc_id, submission_id, case when on_it then '6' else grade end as grade, case when on_it then 'Hilltop School' else school_name end as school_name,
        case when on_it then synced <> '' else needs_review end as needs_review, case when on_it then synced else review_reason_codes end as review_reason_codes from c""", *_V),
    "bulk_rename": T.sql("select doc_id, submission_id, case when school_name = 'Lindenhof Schule' then 'Lindenhof' else school_name end as school_name from submissions", *_S),
    "bulk_to_review": T.sql(f"select doc_id, submission_id, needs_review or {_ON} as needs_review from submissions", *_S),
    "force_approve": T.sql("t as (select doc_id, concat_ws(';', case when no_name then 'student_name' end, case when no_school then 'school_name' end, case when grade_n is null then 'grade' end) as missing from checked) select doc_id, missing, missing = '' as approved from t", *_V),
    "enum_check": T.sql(f"select code, count(*)::bigint as n from (select unnest(list_distinct(string_split(review_reason_codes, ';'))) as code from submissions) where code <> '' and code not in ({', '.join(repr(c) for c in X.ENUM)}) group by 1", *_S),
    "expectations": T.sql("e as (select doc_id, case when doc_id % 8 = 0 then 'MISSING_GRADE' else 'TEMPLATE_ONLY' end as code from submissions where doc_id % 4 = 0) select e.* from e join validated v using (doc_id) where not list_contains(string_split(v.codes, ';'), e.code)", *_V),
    "filter_dashboard": T.sql(f"{_IDS} {_nk('school_name')} = 'lindenhof schule' and not needs_review", *_S),
    "filter_review": T.sql(f"{_IDS} needs_review and coalesce(school_name, '') = '' and contains(review_reason_codes, 'MISSING_')", *_S),
    "filter_excluded": T.sql(f"{_IDS} not list_has_any(string_split(review_reason_codes, ';'), ['CONTENT_MISMATCH', 'BLANK_SUBMISSION'])", *_S),
    "multi_entry": T.sql(f"{_IDS} needs_review and filename in (select filename from submissions group by 1 having count(*) > 1)", *_S),
    "dup_eligible": T.sql(_IDS + _ELIGIBLE, *_S),
    "dups_only": T.sql(f"t as (select *, {_FP} as fingerprint from submissions where {_ELIGIBLE}) select doc_id, submission_id, fingerprint from (select *, count(*) over (partition by fingerprint) as n from t) where n > 1", *_S),
    "approvable": T.sql(f"{_IDS} needs_review and coalesce({_trim('student_name')}, '') <> '' and coalesce({_trim('school_name')}, '') <> '' and coalesce({_trim('grade')}, '') <> '' and review_reason_codes in ('', 'PENDING_REVIEW')", *_S),
    "row_status": T.sql("select doc_id, case when needs_review or review_reason_codes <> '' then 'needs_review' else 'approved' end as dashboard, case when needs_review then 'needs_review' else 'approved' end as filter, case when review_reason_codes <> '' then 'needs_review' else 'approved' end as assignment from submissions", *_S),
    "age_filter": T.sql(f"{_IDS} created_at < timestamp '2024-01-01 10:00:00'", *_S),
    "dashboard_scan": T.sql(f"""t as (select *, {_FP} as fingerprint from submissions where not needs_review and {_ELIGIBLE} and filename in (select filename from submissions group by 1 having count(*) > 1))
      select doc_id, submission_id, fingerprint from (select *, count(*) over (partition by fingerprint) as n from t) where n > 1""", *_S),
}
