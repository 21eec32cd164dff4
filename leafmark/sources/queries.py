"""Sources and sinks as queries: each writes what it reads back, or drains a stream over the tables into files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text
from leafmark.operators import rankings, records, review
from leafmark.plans import tables as T
from leafmark.sources import artifacts
from leafmark.sources.shared import drained, shared_dir
from leafmark.sources.stored import StoredTable
from leafmark.streaming import jobs


def _export_jsonl(s, d):
    """Records as JSON lines, read back under the schema they were written with."""
    rows = T.submissions(s, d).select("doc_id", "submission_id", "student_name", "school_name", "grade", "word_count", "needs_review", "review_reason_codes")
    path = shared_dir(s)
    artifacts.write_jsonl(rows, path)
    return s.read.schema(rows.schema).json(path)


def _stream_intake(s, d):
    """Documents as a stream under their content's id, each content once, with its length. A pattern lets a single file be a stream's source."""
    docs = s.readStream.schema(T.read(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    return drained(jobs.stream_intake(docs).select("submission_id", F.length("text").alias("chars")))


def _job_stream(s, d):
    """Job events as a stream over the table's files."""
    events = T.read(s, d, "events")
    return T.jobs_of(s.readStream.schema(events.schema).parquet(f"{d}/events.parquet*"))


def _stream_waits(s, d):
    """Waits from a stream joined with itself, its pairs drained into files."""
    return jobs.waits(drained(jobs.stream_wait_pairs(_job_stream(s, d))))


def _stream_complete(s, d):
    """Completed batches of a stream of events, each once, as soon as it has a hundred ended ones."""
    with jobs.with_rocksdb(s):
        return drained(jobs.stream_batch_complete(_job_stream(s, d), 100)).select("batch_id", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("completed_at"))


def _stream_window(s, d):
    """Windows of a day, one an hour, of a stream: those that the watermark has passed."""
    wide = jobs.queue_window(_job_stream(s, d).withWatermark("ts", "1 hour"), slide="1 hour")
    return drained(wide).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _stream_logs(s, d):
    """Log lines as a stream of text files, parsed."""
    path = shared_dir(s)
    records.log_lines(T.submissions(s, d)).select("line").write.text(path)
    lines = artifacts.read_logs(s, path, stream=True).withColumn("doc_id", F.lit(None).cast("long"))
    return drained(records.log_parse(lines).drop("doc_id"))


def _artifact_files(s, d):
    """(folder, name, body) of every submission's artifacts: some lack a file, some have one that breaks off or is empty.

    Records are dealt by folder with their text, once, and become files only then; labels decide nothing here, so they are not joined.
    """
    i = F.col("doc_id")
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    docs = T.read(s, d, "documents").where("doc_id is not null").withColumn("quality", F.lit(None).cast("int"))
    subs = T.records_of(docs, "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("stored", F.when(i % 2 == 0, quoted("review_reason_codes")).otherwise(F.concat(F.lit('["'), F.replace("review_reason_codes", F.lit(";"), F.lit('", "')), F.lit('"]'))))
    structured = [F.lit('{"_private": {"a": 1}, "word_count": '), F.col("word_count").cast("string")]
    for c in ("student_name", "school_name", "grade", "doc_type", "format", "extraction_method"):
        structured += [F.lit(f', "{c}": '), quoted(c)]
    bodies = {
        "metadata.json": (i % 11 != 5, F.concat(F.lit("{"), F.when(i % 7 != 2, F.concat(F.lit('"submission_id": '), quoted("submission_id"), F.lit(", "))).otherwise(""), F.lit('"original_filename": '), quoted("filename"), F.lit("}"))),
        "structured.json": (i % 13 != 7, F.concat(*structured, F.lit("}"))),
        "ocr.json": (i % 4 != 1, F.concat(F.lit('{"confidence_avg": '), F.col("ocr_confidence_avg").cast("string"), F.when(i % 17 != 3, "}").otherwise(""))),
        "validation.json": (i % 3 != 2, F.concat(F.lit('{"review_reason_codes": '), F.col("stored"), F.lit("}"))),
        "raw_text.txt": (i % 10 != 9, F.col("text")),
        "essay_block.txt": (i >= 0, F.col("text")),
        "contact_block.txt": (i >= 0, F.coalesce("student_name", F.lit(""))),
        "original.pdf": (i % 3 == 0, F.lit("%PDF")),
        "original.jpg": (i % 3 == 1, F.lit("JPEG")),
    }
    files = F.array(*[F.when(there, F.struct(F.lit(name).alias("name"), body.alias("body"))) for name, (there, body) in bodies.items()])
    dealt = subs.withColumn("folder", F.concat(F.lit("a-"), i.cast("string"))).repartition("folder").sortWithinPartitions("folder")
    return dealt.select("folder", F.inline(F.array_compact(files)))


def _on_artifacts(operator):
    """operator(spark, root) over folders that are written from the tables and read back."""

    def run(s, d):
        root = shared_dir(s)
        artifacts.write_folders(_artifact_files(s, d), root, packed=True, dealt=True)
        return operator(s, root)

    return run


def _import(s, root):
    reference = s.createDataFrame([(v,) for v in T.SCHOOLS.values()], "name string").where("name not like 'Ecole%'").select(text.norm_match(F.col("name")).alias("school_key"))
    return artifacts.reviewed_import(s, root, reference).select("folder", "submission_id", "filename", "student_name", "school_name", "grade", "word_count", "ocr_confidence_avg", "review_reason_codes", "needs_review")


_quoted = lambda c: f"""coalesce('"' || {c} || '"', 'null')"""
_FILES = f"""held as (select s.*, coalesce(d.text, '') as body_text, 'a-' || s.doc_id as folder,
  case when s.doc_id % 2 = 0 then {_quoted("review_reason_codes")} else '["' || replace(review_reason_codes, ';', '", "') || '"]' end as stored from submissions s join documents d using (doc_id)),
files as (
  select doc_id, folder, 'metadata.json' as name, '{{' || case when doc_id % 7 <> 2 then '"submission_id": ' || {_quoted("submission_id")} || ', ' else '' end || '"original_filename": ' || {_quoted("filename")} || '}}' as body from held where doc_id % 11 <> 5
  union all select doc_id, folder, 'structured.json', '{{"_private": {{"a": 1}}, "word_count": ' || word_count || {" || ".join(f"""', "{c}": ' || {_quoted(c)}""" for c in ("student_name", "school_name", "grade", "doc_type", "format", "extraction_method"))} || '}}' from held where doc_id % 13 <> 7
  union all select doc_id, folder, 'ocr.json', '{{"confidence_avg": ' || ocr_confidence_avg || case when doc_id % 17 <> 3 then '}}' else '' end from held where doc_id % 4 <> 1
  union all select doc_id, folder, 'validation.json', '{{"review_reason_codes": ' || stored || '}}' from held where doc_id % 3 <> 2
  union all select doc_id, folder, 'raw_text.txt', body_text from held where doc_id % 10 <> 9
  union all select doc_id, folder, 'essay_block.txt', body_text from held
  union all select doc_id, folder, 'contact_block.txt', coalesce(student_name, '') from held
  union all select doc_id, folder, 'original.pdf', '%PDF' from held where doc_id % 3 = 0
  union all select doc_id, folder, 'original.jpg', 'JPEG' from held where doc_id % 3 = 1)"""
_HEALTH = f"""health as (select folder, count(*) as files, sum(strlen(body))::bigint as bytes,
    concat_ws(',', case when count(*) filter (name in ('original.pdf', 'original.jpg')) = 0 then 'original.pdf/original.jpg' end, {", ".join(f"case when count(*) filter (name = '{n}') = 0 then '{n}' end" for n in artifacts.REQUIRED)}) as missing,
    coalesce(string_agg(name, ',' order by name) filter (name like '%.json' and not json_valid(body)), '') as corrupted,
    coalesce(string_agg(name, ',' order by name) filter (body = ''), '') as empty,
    case when sum(strlen(body)) < {artifacts.LEAST} then 'small' when sum(strlen(body)) > {artifacts.MOST} then 'large' end as odd_size from files group by folder)"""
_IMPORTED = """imported as (select folder, filename, case when doc_id % 7 = 2 then folder else submission_id end as submission_id, student_name, school_name, grade, word_count, doc_type, format, extraction_method,
  case when doc_id % 4 <> 1 then ocr_confidence_avg end as ocr_confidence_avg, case when doc_id % 3 <> 2 then review_reason_codes end as kept, false as is_chunk, false as is_container_parent, null as doc_class
  from held where doc_id % 11 <> 5 and doc_id % 13 <> 7 and not (doc_id % 4 <> 1 and doc_id % 17 = 3))"""


#: Rows of a file where stored tables are queries: fewer than the library's own number, so that small tables have several files, too.
STORED_ROWS = 1000


def _stored(s, rows, key, cluster):
    table = StoredTable(s, shared_dir(s), key, cluster, STORED_ROWS)
    table.create(rows)
    return table


def _stored_upsert(s, d):
    """Records stored, then those of a later table put in: files without any of its ids stay."""
    base, delta = records._base(s, d)
    table = _stored(s, base, ("submission_id",), ("submission_id",))
    table.upsert(delta)
    return table.read()


def _stored_rewrite(s, d):
    """The split set stored, then ids removed, moved and updated in one version."""
    csv, ids = records._csv(s, d), lambda which: records._csv_ids(s, d, which)
    removed, moved, updates = ids("doc_id % 10 = 0"), ids("doc_id % 7 = 0"), ids("doc_id % 4 = 0").withColumn("grade", F.lit("3"))
    table = _stored(s, csv, ("submission_id",), ("submission_id",))
    table.update(reduce(DataFrame.unionByName, [x.select("submission_id") for x in (removed, moved, updates)]), lambda rows: records.csv_rewrite(rows, removed, moved, updates))
    return table.read()


def _stored_replace(s, d):
    """Rankings stored by assignment and reader, then whole groups replaced."""
    new = rankings._new_rankings(s, d)
    table = _stored(s, T.rankings(s, d), ("assignment_id", "reader_id"), ("assignment_id", "reader_id"))
    table.update(new, lambda rows: rankings.replace_group(rows, new))
    return table.read()


def _stored_range(s, d):
    """Records of some hours from a table stored in order of time."""
    table = _stored(s, T.submissions(s, d), ("submission_id",), ("created_at",))
    time = lambda at: F.lit(at).cast("timestamp")
    return table.between("created_at", time("2024-01-01 02:00:00"), time("2024-01-01 09:00:00")).select("doc_id", "owner_user_id")


def _stored_lookup(s, d):
    """Events of three jobs from a table stored in order of time, by the lists' bitmaps."""
    table = _stored(s, T.jobs(s, d), ("job_id",), ("ts",))
    return table.lookup([(3,), (17,), (42,)]).select("event_id", "job_id", "status")


QUERIES = {"export_jsonl": _export_jsonl, "stream_intake": _stream_intake, "stream_logs": _stream_logs, "stream_queue_wait": _stream_waits, "stream_batch_complete": _stream_complete, "stream_queue_window": _stream_window}
QUERIES |= {
    "import_artifacts": _on_artifacts(_import),
    "artifact_status": _on_artifacts(lambda s, root: artifacts.artifact_records(s, root).select("folder", "status")),
    "artifact_health": _on_artifacts(artifacts.artifact_health),
    "artifact_health_summary": _on_artifacts(lambda s, root: artifacts.health_summary(artifacts.artifact_health(s, root))),
    "pick_paths": _on_artifacts(lambda s, root: artifacts.pick_paths(s, root, ("ocr.json", "metadata.json", "original.pdf"))),
}
ORACLE = {
    "export_jsonl": T.sql("select doc_id, submission_id, student_name, school_name, grade, word_count, needs_review, review_reason_codes from submissions", T.SUBMISSIONS),
    "stream_intake": "select distinct substr(sha256(text), 1, 12) as submission_id, length(text) as chars from documents",
    "stream_logs": T.sql(f"select strftime(created_at, '%Y-%m-%d %H:%M:%S') as at, {records._LINE} as level, submission_id as job_id, filename from submissions", T.SUBMISSIONS),
}
ORACLE |= {
    "import_artifacts": T.sql(
        "select folder, submission_id, filename, student_name, school_name, grade, word_count, ocr_confidence_avg, coalesce(nullif(kept, ''), codes) as review_reason_codes, true as needs_review from validated",
        T.SUBMISSIONS, _FILES, _IMPORTED, review.CHECKED.replace("from submissions)", "from imported)"),
    ),
    "artifact_status": T.sql(
        """select folder, case when doc_id % 11 = 5 or doc_id % 13 = 7 then 'skipped' when doc_id % 4 <> 1 and doc_id % 17 = 3 then 'error' else 'imported' end as status from held""", T.SUBMISSIONS, _FILES
    ),
    "artifact_health": T.sql("select *, missing = '' and corrupted = '' and empty = '' as healthy from health", T.SUBMISSIONS, _FILES, _HEALTH),
    "artifact_health_summary": T.sql(
        """select count(*) as folders, count(*) filter (missing = '' and corrupted = '' and empty = '') as healthy, sum(bytes)::bigint as bytes, count(*) filter (missing <> '') as missing,
        count(*) filter (corrupted <> '') as corrupted, count(*) filter (empty <> '') as empty, count(odd_size) as odd_size from health""", T.SUBMISSIONS, _FILES, _HEALTH,
    ),
    "pick_paths": T.sql("select folder || '/' || name as path from files where name in ('ocr.json', 'metadata.json', 'original.pdf')", T.SUBMISSIONS, _FILES),
}
QUERIES |= {
    "stored_upsert": _stored_upsert, "stored_rewrite": _stored_rewrite, "stored_replace_group": _stored_replace, "stored_time_range": _stored_range, "stored_lookup": _stored_lookup,
}
_MERGED = records.ORACLE["upsert_records"]
ORACLE |= {
    "stored_upsert": f"select * exclude (action, previous_owner) from ({_MERGED})",
    "stored_rewrite": records.ORACLE["csv_rewrite"],
    "stored_replace_group": rankings.ORACLE["replace_group"],
    "stored_time_range": records.ORACLE["scan_time_range"],
    "stored_lookup": T.sql("select event_id, job_id, status from jobs where job_id in (3, 17, 42)", T.JOBS),
}
_BEFORE = "b as (select *, lag(status) over w as s, lag(ts) over w as t from jobs where status in ('queued', 'started') window w as (partition by job_id order by ts, event_id))"
ORACLE |= {
    "stream_queue_wait": T.sql(f"{_BEFORE} select event_id, job_id, ((epoch_us(ts) - epoch_us(t)) // 1000)::bigint as wait_ms from b where status = 'started' and s = 'queued' and t >= ts - interval 7 days", T.JOBS),
    "stream_batch_complete": jobs.ORACLE["batch_complete"],
    "stream_queue_window": f"select * from ({jobs.ORACLE['queue_window_hourly']}) where window_start::timestamp + interval 24 hours <= (select max(ts) from events where event_type in ('click', 'view', 'purchase', 'error')) - interval 1 hour",
}
