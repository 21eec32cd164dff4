"""The domain's relations, derived from the driver's tables: once as DataFrames, once as SQL.

Every relation is a narrow projection (submissions: one equi-join) of a table, so filters and column
pruning reach the Parquet scan through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_NAMES = ("Alva", "Bram", "Cleo", "Dina", "Egon", "Fara", "Gero", "Hana")
LAST_NAMES = ("Asher", "Brook", "Corin", "Drake", "Ember", "Flint", "Grove", "Hazel")
SCHOOLS = {"en": "North Ridge Elementary", "de": "Lindenhof Schule", "fr": "Ecole du Parc", "es": "Escuela del Sol"}
DOC_TYPES = (
    "ifi_typed_form_submission",
    "ifi_official_form_scanned",
    "ifi_official_form_filled",
    "essay_with_header_metadata",
    "standard_freeform_essay",
    "bulk_scanned_batch",
    "template",
    "unknown",
    "essay_only",
)
DOC_CLASSES = ("SINGLE_TYPED", "SINGLE_SCANNED", "MULTI_PAGE_SINGLE", "BULK_SCANNED_BATCH", "MULTI_ENTRY_PARENT")
FORMATS = ("native_text", "image_only", "hybrid")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a 0-based index."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) + 1]"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document: identity, extracted fields, stored review state."""
    return records_of(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"))


def records_of(docs: DataFrame, *more: str) -> DataFrame:
    """Records of documents with their quality, and more of their columns."""
    i = F.col("doc_id")
    school = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in SCHOOLS.items()])
    form = i % 9
    school = (
        F.when(form == 0, None)
        .when(form == 1, F.upper(school))
        .when(form == 2, F.concat(F.lit("  "), school, F.lit(" ")))
        .when(form == 3, F.replace(school, F.lit(" "), F.lit("   ")))
        .otherwise(school)
    )
    name = F.concat(pick(FIRST_NAMES, i % 8), F.lit(" "), pick(LAST_NAMES, F.floor(i / 8) % 8))
    grade = (
        F.when(i % 19 == 0, None).when(i % 15 == 12, "K").when(i % 15 == 11, "Grade 11").when(i % 15 == 10, "10th").otherwise((i % 15).cast("string"))
    )
    words = F.when(i % 29 == 0, F.lit(0)).otherwise(F.floor(F.col("n_chars") / 6)).cast("long")
    base = docs.select(
        "doc_id",
        F.substring(F.sha2("text", 256), 1, 12).alias("submission_id"),
        F.col("source").alias("owner_user_id"),
        F.when(i % 13 == 0, None).when(i % 17 == 0, school).otherwise(name).alias("student_name"),
        school.alias("school_name"),
        grade.alias("grade"),
        F.concat("source", F.lit("-"), (i % 50).cast("string"), F.lit(".pdf")).alias("filename"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
        ((i % 100) / 100.0).alias("ocr_confidence_avg"),
        words.alias("word_count"),
        pick(DOC_CLASSES, i % 5).alias("doc_class"),
        pick(DOC_TYPES, i % 9).alias("doc_type"),
        pick(FORMATS, i % 3).alias("format"),
        F.when(i % 10 == 3, "fallback").otherwise("rules").alias("extraction_method"),
        (i % 6 == 1).alias("is_chunk"),
        (i % 25 == 4).alias("is_container_parent"),
        F.when(i % 6 == 1, F.concat(F.lit("p"), F.floor(i / 6).cast("string"))).alias("parent_submission_id"),
        (i % 10).alias("batch_id"),
        F.when(i % 4 == 0, "manual").when(i % 4 == 1, "batch_default").otherwise("extracted").alias("school_source"),
        F.coalesce("quality", F.lit(1)).alias("quality"),
        *more,
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("word_count") == 0, "EMPTY_ESSAY"),
            F.when(F.col("grade").isNull(), "MISSING_GRADE"),
            F.when(F.col("school_name").isNull(), "MISSING_SCHOOL_NAME"),
            F.when(F.col("student_name").isNull(), "MISSING_STUDENT_NAME"),
            F.when(F.col("ocr_confidence_avg") < 0.2, "OCR_LOW_CONFIDENCE"),
            F.when(i % 23 == 0, "PENDING_REVIEW"),
            F.when((F.col("word_count") > 0) & (F.col("word_count") < 50), "SHORT_ESSAY"),
        )
    )
    return base.withColumn("review_reason_codes", F.array_join(codes, ";")).withColumn("needs_review", (F.col("review_reason_codes") != "") | (i % 31 == 0))


_school = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in SCHOOLS.items()) + " end"
SUBMISSIONS = f"""
submissions_0 as (
  select d.doc_id, substr(sha256(text), 1, 12) as submission_id, source as owner_user_id,
    case doc_id % 9 when 0 then null when 1 then upper({_school}) when 2 then '  ' || {_school} || ' '
      when 3 then replace({_school}, ' ', '   ') else {_school} end as school_name,
    {_sql_pick(FIRST_NAMES, "doc_id % 8")} || ' ' || {_sql_pick(LAST_NAMES, "doc_id // 8 % 8")} as full_name,
    case when doc_id % 19 = 0 then null when doc_id % 15 = 12 then 'K' when doc_id % 15 = 11 then 'Grade 11'
      when doc_id % 15 = 10 then '10th' else (doc_id % 15)::varchar end as grade,
    source || '-' || (doc_id % 50) || '.pdf' as filename,
    timestamp '2024-01-01' + to_minutes(doc_id) as created_at, doc_id % 100 / 100.0::double as ocr_confidence_avg,
    case when doc_id % 29 = 0 then 0 else n_chars // 6 end as word_count,
    {_sql_pick(DOC_CLASSES, "doc_id % 5")} as doc_class, {_sql_pick(DOC_TYPES, "doc_id % 9")} as doc_type,
    {_sql_pick(FORMATS, "doc_id % 3")} as format, case when doc_id % 10 = 3 then 'fallback' else 'rules' end as extraction_method,
    doc_id % 6 = 1 as is_chunk, doc_id % 25 = 4 as is_container_parent,
    case when doc_id % 6 = 1 then 'p' || (doc_id // 6) end as parent_submission_id, doc_id % 10 as batch_id,
    case when doc_id % 4 = 0 then 'manual' when doc_id % 4 = 1 then 'batch_default' else 'extracted' end as school_source,
    coalesce(quality, 1) as quality
  from documents d left join labels l using (doc_id)),
submissions_1 as (
  select * exclude full_name, case when doc_id % 13 = 0 then null when doc_id % 17 = 0 then school_name else full_name end as student_name from submissions_0),
submissions as (
  select *, review_reason_codes <> '' or doc_id % 31 = 0 as needs_review from (
    select *, concat_ws(';', case when word_count = 0 then 'EMPTY_ESSAY' end, case when grade is null then 'MISSING_GRADE' end,
      case when school_name is null then 'MISSING_SCHOOL_NAME' end, case when student_name is null then 'MISSING_STUDENT_NAME' end,
      case when ocr_confidence_avg < 0.2 then 'OCR_LOW_CONFIDENCE' end, case when doc_id % 23 = 0 then 'PENDING_REVIEW' end,
      case when word_count > 0 and word_count < 50 then 'SHORT_ESSAY' end) as review_reason_codes from submissions_1))
"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' ranks: assignment, reader, submission, position."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assignment_id"),
        F.col("l_suppkey").alias("reader_id"),
        F.col("l_partkey").alias("submission_id"),
        F.col("l_linenumber").alias("rank_position"),
        F.concat(F.lit("reader"), F.col("l_suppkey").cast("string"), F.lit("@example.org")).alias("reader_email"),
    )


RANKINGS = """
rankings as (select l_orderkey as assignment_id, l_suppkey as reader_id, l_partkey as submission_id, l_linenumber as rank_position,
  'reader' || l_suppkey || '@example.org' as reader_email from lineitem)
"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader assignments to a batch of a grade; completed ones carry a time."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("assignment_id"),
        F.col("o_custkey").alias("reader_id"),
        F.col("o_orderpriority").alias("grade"),
        F.concat(F.lit("school "), (F.col("o_custkey") % 7).cast("string")).alias("school_name"),
        (F.col("o_orderkey") % 12).alias("batch_number"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("completed_at"),
        F.col("o_orderdate").alias("created_at"),
    )


ASSIGNMENTS = """
assignments as (select o_orderkey as assignment_id, o_custkey as reader_id, o_orderpriority as grade, 'school ' || (o_custkey % 7) as school_name,
  o_orderkey % 12 as batch_number, case when o_orderstatus = 'F' then o_orderdate end as completed_at, o_orderdate as created_at from orders)
"""


def finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of the second round with their essays, in a fixed order."""
    lines = read(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0")
    return lines.select(
        F.col("l_orderkey").alias("assignment_id"), F.col("l_partkey").alias("submission_id"), F.col("l_linenumber").alias("finalist_position")
    )


FINALISTS = """
finalists as (select l_orderkey as assignment_id, l_partkey as submission_id, l_linenumber as finalist_position from lineitem where l_orderkey % 10 = 0)
"""


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essay records that rankings refer to."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("submission_id"), F.col("p_name").alias("student_name"), F.col("p_brand").alias("school_name"), F.col("p_size").alias("grade")
    ).where("submission_id % 17 <> 0")


ESSAYS = """
essays as (select p_partkey as submission_id, p_name as student_name, p_brand as school_name, p_size as grade from part where p_partkey % 17 <> 0)
"""


def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers by id, with e-mail and name."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("reader_id"),
        F.concat(F.lit("Reader"), (F.col("c_custkey") % 97).cast("string"), F.lit("@Example.org")).alias("email"),
        F.col("c_name").alias("name"),
    )


READERS = """
readers as (select c_custkey as reader_id, 'Reader' || (c_custkey % 97) || '@Example.org' as email, c_name as name from customer)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of jobs; event types without a status are left out."""
    return jobs_of(read(spark, sf_dir, "events"))


def jobs_of(events: DataFrame) -> DataFrame:
    """Status events of jobs from events, as a table or a stream."""
    status = {"click": "queued", "view": "started", "purchase": "finished", "error": "failed"}
    return events.where(F.col("event_type").isin(*status)).select(
        F.col("event_id"),
        F.col("user_id").alias("job_id"),
        (F.col("user_id") % 10).alias("batch_id"),
        F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in status.items()]).alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.col("props").alias("payload"),
    )


JOBS = """
jobs as (select event_id, user_id as job_id, user_id % 10 as batch_id,
  case event_type when 'click' then 'queued' when 'view' then 'started' when 'purchase' then 'finished' when 'error' then 'failed' end as status,
  ts, value, props as payload from events where event_type in ('click', 'view', 'purchase', 'error'))
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of documents; some pages start with a form header."""
    header = F.col("role").isin("system", "user")
    text = F.when(header, F.concat(F.lit("Student Name Grade School Essay\n"), F.col("text"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "role", text.alias("text"))


PAGES = """
doc_pages as (select conv_id as doc_id, turn as page_index, role,
  case when role in ('system', 'user') then 'Student Name Grade School Essay' || chr(10) || text else text end as text from conversations)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage timings of processed chunks."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("doc_class"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("processing_ms"), F.col("l_quantity").alias("queue_wait_ms")
    )


METRICS = """
metrics as (select l_returnflag as doc_class, l_linestatus as status, l_extendedprice as processing_ms, l_quantity as queue_wait_ms from lineitem)
"""


def sql(body: str, *relations: str) -> str:
    """A statement over the named relations; body starts with select, or with the first of further CTEs."""
    start = ", " if not body.lstrip().startswith("select") else " "
    return "with " + ", ".join(relations) + start + body if relations else body
