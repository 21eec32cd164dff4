"""Record tables: scans, updates, duplicates, batch defaults, artifacts.

Updates give the new table, and what changed where that is asked for; the caller writes it as a new version. Parquet has no
MERGE. None of these scans stops at a number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators import review as R
from leafmark.plans import tables as T

ARTIFACTS = ("metadata.json", "ocr.json", "structured.json", "validation.json")


def content_id(c: Column) -> Column:
    """The first 12 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)


def chunk_ids(records: DataFrame) -> DataFrame:
    """Ids of chunks: by base id and index, and the form that names the parent."""
    base, i = F.col("submission_id"), F.col("chunk_index").cast("string")
    return records.select("doc_id", "chunk_index", content_id(F.concat_ws(":", base, i)).alias("chunk_id"), F.concat_ws("_", base, i, F.substring(F.sha2(F.concat_ws(":", base, i), 256), 1, 8)).alias("long_id"))


def scan_records(records: DataFrame, owner: str | None = None, needs_review: bool | None = None, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """Records of an owner and a state, newest first. Filters and columns reach the scan."""
    out = records
    if owner is not None:
        out = out.where(F.col("owner_user_id") == owner)
    if needs_review is not None:
        out = out.where(F.col("needs_review") == needs_review)
    return out.orderBy(F.desc("created_at"), "doc_id").select(*columns)


def scan_time_range(records: DataFrame, start: str, end: str, owner: str | None = None) -> DataFrame:
    out = records.where((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp")))
    return out.where(F.col("owner_user_id") == owner) if owner else out


def lookup_owned(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records by id for those who own them; a request without an owner finds nothing."""
    return records.join(ids.where("owner_user_id is not null"), ["submission_id", "owner_user_id"], "left_semi")


def owner_view(jobs: DataFrame, owner: str) -> DataFrame:
    """Jobs whose payload names the owner."""
    return jobs.where(F.get_json_object("payload", "$.k").cast("string") == owner)


def csv_columns(records: DataFrame) -> DataFrame:
    """Records as the text columns of the split CSV sink: nulls and a confidence of 0 are empty."""
    conf = F.col("ocr_confidence_avg")
    return records.select(
        "submission_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("student_name", "school_name", "grade", "word_count")],
        F.when(F.coalesce(conf, F.lit(0.0)) == 0, "").otherwise(F.format_string("%.2f", conf)).alias("ocr_confidence_avg"),
        F.col("review_reason_codes"), F.when(F.col("needs_review"), "needs_review").otherwise("clean").alias("split"),
    )


def write_csv_split(records: DataFrame, path: str) -> None:
    csv_columns(records).write.partitionBy("split").option("header", True).csv(path)


def csv_counts(csv: DataFrame) -> DataFrame:
    return csv.groupBy("split").agg(F.count("*").alias("n"))


def csv_rewrite(csv: DataFrame, removed: DataFrame, moved: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows of a split set without the removed ids, with updates applied and moved ids in the other split."""
    rest = csv.join(removed.select("submission_id"), "submission_id", "left_anti")
    patched = rest.join(updates.select("submission_id", F.col("grade").alias("__g")), "submission_id", "left").withColumn("grade", F.coalesce("__g", "grade")).drop("__g")
    flags = moved.select("submission_id", F.lit(True).alias("__m")).distinct()
    other = F.when(F.col("split") == "clean", "needs_review").otherwise("clean")
    return patched.join(flags, "submission_id", "left").withColumn("split", F.when(F.col("__m"), other).otherwise(F.col("split"))).drop("__m")


def upsert_records(base: DataFrame, delta: DataFrame, key: str = "submission_id") -> DataFrame:
    """All records with those of delta in place of base's, and action and previous_owner of the changed."""
    b = base.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in base.columns if c != key], F.lit(True).alias("__b"))
    d = delta.select(F.col(key), *[F.col(c).alias(f"d_{c}") for c in base.columns if c != key], F.lit(True).alias("__d"))
    new = F.coalesce("__d", F.lit(False))
    columns = [F.when(new, F.col(f"d_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in base.columns if c != key]
    action = F.when(~new, "kept").when(F.col("__b"), "updated").otherwise("inserted")
    return b.join(d, key, "full").select(key, *columns, action.alias("action"), F.when(new, F.col("b_owner_user_id")).alias("previous_owner"))


PATCHABLE = ("student_name", "school_name", "grade")


def patch_records(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records with the permitted columns of their owner's patches applied where not null."""
    allowed = [c for c in patches.columns if c in PATCHABLE]
    p = patches.select("submission_id", "owner_user_id", *[F.col(c).alias(f"__{c}") for c in allowed])
    return records.join(p, ["submission_id", "owner_user_id"], "left").withColumns({c: F.coalesce(f"__{c}", c) for c in allowed}).drop(*[f"__{c}" for c in allowed])


def delete_owned(records: DataFrame, requests: DataFrame) -> DataFrame:
    return records.join(requests, ["submission_id", "owner_user_id"], "left_anti")


def bulk_delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    """What becomes of each id asked to be deleted."""
    there = records.select("submission_id", F.lit(True).alias("__t")).distinct()
    return ids.distinct().join(there, "submission_id", "left").select("submission_id", F.when(F.col("__t"), "deleted").otherwise("not_found").alias("result"))


def export_approved(records: DataFrame) -> DataFrame:
    rows = records.where("not needs_review and review_reason_codes = ''")
    out = rows.select("submission_id", "student_name", "school_name", "grade", "filename", F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("date"))
    return out.orderBy("school_name", "grade", "student_name", "submission_id")


def json_safe(jobs: DataFrame) -> DataFrame:
    """The payload's number, or null where the payload is not JSON."""
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("payload"))).otherwise(F.col("payload"))
    parsed = F.from_json(broken, "k double", {"mode": "PERMISSIVE"})
    return jobs.select("event_id", parsed["k"].alias("k"))


LINK = r"""href=["']([^"']*)["']"""


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of every page with the place of their first mention."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("place", "link"))
    return found.where("link <> ''").groupBy("page_id", "link").agg(F.min("place").alias("first_place"))


def log_lines(records: DataFrame) -> DataFrame:
    """Log text for records: time, service, job and state of each."""
    level = F.when(F.col("doc_id") % 7 == 0, "FAILED").when(F.col("doc_id") % 5 == 0, "WARN slow").otherwise("done")
    return records.select("doc_id", F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" worker job="), F.col("submission_id"), F.lit(" file="), F.col("filename"), F.lit(" "), level).alias("line"))


def log_parse(lines: DataFrame) -> DataFrame:
    """Structured rows of log lines."""
    c = F.col("line")
    upper = F.upper(c)
    level = F.when(upper.rlike("ERROR|FAILED"), "ERROR").when(upper.contains("WARN"), "WARNING").otherwise("INFO")
    field = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return lines.select(
        "doc_id", field(r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})").alias("at"), level.alias("level"), field(r"job=([0-9a-f]+)").alias("job_id"), field(r"file=([^ ]+\.pdf)").alias("filename")
    )


def path_parse(paths: DataFrame) -> DataFrame:
    """Artifact prefix, chunk index and id in artifact paths."""
    c = F.col("path")
    field = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return paths.select("doc_id", field(r"^(.*)/[^/]+$").alias("prefix"), field(r"chunk_(\d+)").cast("long").alias("chunk_index"), field(r"_([0-9a-f]{12})/").alias("submission_id"))


def run_log_summary(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Files of a batch run by outcome, and how many of them were saved."""
    flags = saved.select("submission_id", F.lit(True).alias("__s")).distinct()
    return files.join(flags, "submission_id", "left").groupBy("status").agg(F.count("*").alias("files"), F.count_if(F.col("__s")).alias("verified"))


def verify_by_file(records: DataFrame) -> DataFrame:
    """Chunks, states and ids of each file."""
    return records.groupBy("filename").agg(
        F.count("*").alias("chunk_count"), F.count_if(F.col("needs_review")).alias("review"), F.array_join(F.array_sort(F.collect_set("submission_id")), ",").alias("ids")
    )


def verify_saved(processed: DataFrame, saved: DataFrame) -> DataFrame:
    flags = saved.select("submission_id", "owner_user_id", F.lit(True).alias("__s")).distinct()
    return processed.join(flags, ["submission_id", "owner_user_id"], "left").select("doc_id", F.col("__s").isNotNull().alias("verified"))


def dup_plan(records: DataFrame) -> DataFrame:
    """For each fingerprint of several records, the newest kept and the others to delete."""
    rows = R.dups_only(records)
    order = Window.partitionBy("fingerprint").orderBy(F.desc("created_at"), "doc_id")
    return rows.withColumn("nth", F.row_number().over(order)).select("doc_id", "fingerprint", F.when(F.col("nth") == 1, "keep").otherwise("delete").alias("action"))


def dup_upload(uploads: DataFrame, records: DataFrame) -> DataFrame:
    """Whether each upload is there already, under its id or its older form, and whose it is."""
    ids = uploads.select("doc_id", F.col("owner_user_id").alias("__o"), F.explode(F.array("upload_id", content_id(F.concat("upload_id", F.lit(":0"))))).alias("submission_id"))
    owners = records.select("submission_id", "owner_user_id").distinct()
    met = ids.join(owners, "submission_id", "left").withColumn("own", F.col("owner_user_id") == F.col("__o"))
    found = met.groupBy("doc_id").agg(F.max(F.col("own").cast("int")).alias("m"))
    return found.select("doc_id", F.when(F.col("m").isNull(), "new").when(F.col("m") == 1, "own_duplicate").otherwise("other_owner").alias("result"))


def dup_selected(records: DataFrame, selected: DataFrame) -> DataFrame:
    """What to do with each selected record: delete it as a duplicate, or why not."""
    plan = dup_plan(records).select("doc_id", "action")
    marked = selected.join(records.select("doc_id", R.dup_eligible().alias("eligible")), "doc_id", "left").join(plan, "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("eligible").isNull(), "not_found").when(~F.col("eligible"), "not_eligible").when(F.col("action").isNull(), "no_peers").when(F.col("action") == "keep", "newest_kept").otherwise("delete").alias("result"))


def peers_union(*fetches: DataFrame) -> DataFrame:
    """Peers of several fetches without repeats."""
    out = fetches[0]
    for f in fetches[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["doc_id"])


def orphans(folders: DataFrame, records: DataFrame) -> DataFrame:
    """Artifact folders without a record, and their size by owner."""
    return folders.join(records.select("submission_id"), "submission_id", "left_anti").groupBy("owner_user_id").agg(F.count("*").alias("folders"), F.sum("bytes").alias("bytes"))


def normalize_join(records: DataFrame, payloads: DataFrame, index: DataFrame) -> DataFrame:
    """Records with values from their artifacts where their own are missing, and whether artifacts are there."""
    p = payloads.select("submission_id", F.col("school").alias("p_school"), F.col("words").alias("p_words")).groupBy("submission_id").agg(F.max("p_school").alias("p_school"), F.max("p_words").alias("p_words"))
    i = index.select("submission_id", F.lit(True).alias("__i")).distinct()
    joined = records.join(p, "submission_id", "left").join(i, "submission_id", "left")
    return joined.select("doc_id", F.coalesce("school_name", "p_school").alias("school"), F.coalesce(F.nullif("word_count", F.lit(0)), "p_words").alias("words"), F.col("__i").isNull().alias("artifact_missing"))


def readers_merge(readers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Readers' e-mails with the missing of the wanted ones added."""
    known = readers.select(F.lower("email").alias("email")).distinct()
    new = wanted.select(F.lower("email").alias("email")).distinct().join(known, "email", "left_anti")
    return known.withColumn("origin", F.lit("known")).unionByName(new.withColumn("origin", F.lit("created")))


def batch_defaults(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Blank schools and grades filled from their batch unless set by hand, with sources and codes in line."""
    joined = records.join(batches, "batch_id", "left")
    free = F.col("school_source") != "manual"
    school = free & (F.coalesce(F.trim("school_name"), F.lit("")) == "") & (F.coalesce(F.trim("default_school"), F.lit("")) != "")
    grade = free & (F.coalesce(F.trim("grade"), F.lit("")) == "") & (F.coalesce(F.trim("default_grade"), F.lit("")) != "")
    filled = joined.withColumn("__s", school).withColumn("__g", grade)
    codes = X.codes_norm(F.col("review_reason_codes"))
    codes = F.when(F.col("__s"), F.array_remove(codes, "MISSING_SCHOOL_NAME")).otherwise(codes)
    codes = F.when(F.col("__g"), F.array_remove(codes, "MISSING_GRADE")).otherwise(codes)
    return filled.select(
        "doc_id",
        F.when(F.col("__s"), F.trim("default_school")).otherwise(F.col("school_name")).alias("school_name"),
        F.when(F.col("__g"), F.trim("default_grade")).otherwise(F.col("grade")).alias("grade"),
        F.when(F.col("__s"), "batch_default").otherwise(F.col("school_source")).alias("school_source"),
        F.array_join(codes, ";").alias("review_reason_codes"),
        (F.col("__s") | F.col("__g")).alias("updated"),
    )


def artifact_index(found: DataFrame) -> DataFrame:
    """Missing expected artifacts of each submission, from (submission_id, name) of those that are there."""
    expected = F.array(*[F.lit(a) for a in ARTIFACTS])
    return found.groupBy("doc_id").agg(F.collect_set("name").alias("have")).select("doc_id", F.array_join(F.array_sort(F.array_except(expected, "have")), ",").alias("missing")).withColumn("artifact_missing", F.col("missing") != "")


def reingest(uploads: DataFrame) -> DataFrame:
    """Uploads of content that was uploaded before, with the previous owner."""
    before = Window.partitionBy("submission_id").orderBy("created_at", "doc_id")
    return uploads.withColumn("previous_owner", F.lag("owner_user_id").over(before)).where("previous_owner is not null").select("doc_id", "submission_id", "owner_user_id", "previous_owner")


def reextract_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """(key, field, before, after) of every value that differs; null counts as a value."""
    both = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields]).join(new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields]), key)
    rows = both.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("before"), F.col(f"n_{c}").alias("after")) for c in fields])).alias("d")).select(key, "d.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def _subs(s, d):
    return T.submissions(s, d)


def _chunks(s, d):
    return _subs(s, d).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))


def _wanted_ids(s, d):
    return _subs(s, d).where("doc_id % 4 = 0").select("submission_id", F.when(F.col("doc_id") % 8 == 0, F.col("owner_user_id")).when(F.col("doc_id") % 12 == 0, F.lit("src0")).alias("owner_user_id")).distinct()


SLIM = ("submission_id", "owner_user_id", "student_name", "grade")


def _base(s, d):
    one = _subs(s, d).groupBy("submission_id").agg(*[F.min_by(c, "doc_id").alias(c) for c in SLIM[1:]], F.min("doc_id").alias("i"))
    return one.where("i % 5 <> 0").drop("i"), one.where("i % 3 = 0").withColumn("owner_user_id", F.concat("owner_user_id", F.lit("b"))).withColumn("grade", F.lit("7")).drop("i")


def _patches(s, d):
    return _subs(s, d).where("doc_id % 6 = 0").select("submission_id", F.when(F.col("doc_id") % 12 == 0, "nobody").otherwise(F.col("owner_user_id")).alias("owner_user_id"), F.lit("9").alias("grade"), F.lit("x").alias("doc_class")).distinct()


def _csv(s, d):
    one = _subs(s, d).dropDuplicates(["doc_id"]).withColumn("submission_id", F.concat("submission_id", F.lit("-"), F.col("doc_id").cast("string")))
    return csv_columns(one)


def _csv_ids(s, d, cond):
    return _subs(s, d).where(cond).select(F.concat("submission_id", F.lit("-"), F.col("doc_id").cast("string")).alias("submission_id"))


def _uploads(s, d):
    return _subs(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("owner_user_id")).otherwise("src1").alias("owner_user_id"), F.when(F.col("doc_id") % 3 == 0, F.col("submission_id")).otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("upload_id"))


def _found(s, d):
    names = F.filter(F.array(*[F.lit(a) for a in ARTIFACTS]), lambda a: F.pmod(F.length(a) + F.col("doc_id"), F.lit(4)) != 0)
    return _subs(s, d).select("doc_id", F.explode(names).alias("name"))


def _batches(s, d):
    return T.read(s, d, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("batch_id"), F.col("n_name").alias("default_school"), F.when(F.col("n_nationkey") % 2 == 0, "4").alias("default_grade"))


def _selected(s, d):
    return _subs(s, d).where("doc_id % 3 = 0").select("doc_id").unionByName(_subs(s, d).where("doc_id % 100 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id")))


QUERIES = {
    "ingest_ids": lambda s, d: T.read(s, d, "documents").select("doc_id", content_id(F.col("text")).alias("submission_id"), F.octet_length("text").cast("long").alias("byte_size")),
    "chunk_ids": lambda s, d: chunk_ids(_chunks(s, d)),
    "scan_records": lambda s, d: scan_records(_subs(s, d), owner="src3", needs_review=True, columns=("doc_id", "submission_id", "filename")),
    "scan_time_range": lambda s, d: scan_time_range(_subs(s, d), "2024-01-01 02:00:00", "2024-01-01 09:00:00").select("doc_id", "owner_user_id"),
    "lookup_owned": lambda s, d: lookup_owned(_subs(s, d), _wanted_ids(s, d)).select("doc_id", "submission_id"),
    "owner_view": lambda s, d: owner_view(T.jobs(s, d), "7").select("event_id", "status"),
    "csv_split_sink": _csv,
    "csv_counts": lambda s, d: csv_counts(_csv(s, d)),
    "csv_rewrite": lambda s, d: csv_rewrite(_csv(s, d), _csv_ids(s, d, "doc_id % 10 = 0"), _csv_ids(s, d, "doc_id % 7 = 0"), _csv_ids(s, d, "doc_id % 4 = 0").withColumn("grade", F.lit("3"))),
    "upsert_records": lambda s, d: upsert_records(*_base(s, d)),
    "patch_records": lambda s, d: patch_records(_subs(s, d), _patches(s, d)).select("doc_id", "grade", "doc_class"),
    "delete_owned": lambda s, d: delete_owned(_subs(s, d), _patches(s, d).select("submission_id", "owner_user_id")).select("doc_id", "submission_id"),
    "bulk_delete": lambda s, d: bulk_delete(_subs(s, d), _uploads(s, d).select(F.col("upload_id").alias("submission_id"))),
    "export_approved": lambda s, d: export_approved(_subs(s, d)),
    "json_safe": lambda s, d: json_safe(T.jobs(s, d)),
    "extract_links": lambda s, d: extract_links(T.read(s, d, "pages")),
    "log_parse": lambda s, d: log_parse(log_lines(_subs(s, d))),
    "path_parse": lambda s, d: path_parse(_subs(s, d).select("doc_id", F.concat(F.lit("in/chunk_"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 7).cast("string")).otherwise("x"), F.lit("_"), "submission_id", F.lit("/ocr.json")).alias("path"))),
    "run_log_summary": lambda s, d: run_log_summary(_subs(s, d).select("submission_id", F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("ok").alias("status")), _subs(s, d).where("doc_id % 4 <> 0")),
    "verify_by_file": lambda s, d: verify_by_file(_subs(s, d)),
    "verify_saved": lambda s, d: verify_saved(_subs(s, d), _subs(s, d).where("doc_id % 4 <> 0")),
    "dup_plan": lambda s, d: dup_plan(_subs(s, d)),
    "dup_upload": lambda s, d: dup_upload(_uploads(s, d), _subs(s, d)),
    "dup_selected": lambda s, d: dup_selected(_subs(s, d), _selected(s, d)),
    "peers_union": lambda s, d: peers_union(*[_subs(s, d).where(c).select("doc_id", "submission_id") for c in ("doc_id % 2 = 0", "doc_id % 3 = 0", "needs_review")]),
    "orphans": lambda s, d: orphans(_subs(s, d).select("submission_id", "owner_user_id", F.col("word_count").alias("bytes")), _subs(s, d).where("doc_id % 3 <> 0")),
    "normalize_join": lambda s, d: normalize_join(_subs(s, d), _subs(s, d).where("doc_id % 2 = 0").select("submission_id", F.lit("from artifact").alias("school"), F.lit(11).cast("long").alias("words")), _subs(s, d).where("doc_id % 5 <> 0")),
    "readers_merge": lambda s, d: readers_merge(T.readers(s, d), T.rankings(s, d).select(F.col("reader_email").alias("email"))),
    "readers_merge_all": lambda s, d: readers_merge(T.readers(s, d), T.rankings(s, d).select(F.col("reader_email").alias("email"))),
    "batch_defaults": lambda s, d: batch_defaults(_subs(s, d), _batches(s, d)),
    "artifact_index": lambda s, d: artifact_index(_found(s, d)),
    "reingest": lambda s, d: reingest(_subs(s, d)),
    "reextract_diff": lambda s, d: reextract_diff(_subs(s, d), _subs(s, d).withColumn("grade", X.grade_policy(F.col("grade"))[0]).withColumn("school_name", X.display_name(F.col("school_name"))), ("grade", "school_name", "student_name")),
}

_S = (T.SUBMISSIONS,)
_FP = R._FP
_DUPS = f"""
eligible as (select *, {_FP} as fingerprint from submissions where {R._ELIGIBLE}),
planned as (select doc_id, fingerprint, case when row_number() over (partition by fingerprint order by created_at desc, doc_id) = 1 then 'keep' else 'delete' end as action
  from (select *, count(*) over (partition by fingerprint) as n from eligible) where n > 1)
"""
_CSV = """
csv as (select submission_id || '-' || doc_id as submission_id, coalesce(student_name, '') as student_name, coalesce(school_name, '') as school_name, coalesce(grade, '') as grade, coalesce(word_count::varchar, '') as word_count,
  case when ocr_confidence_avg = 0 then '' else printf('%.2f', ocr_confidence_avg) end as ocr_confidence_avg, review_reason_codes, case when needs_review then 'needs_review' else 'clean' end as split, doc_id from submissions)
"""
_BASE = """
one as (select submission_id, arg_min(owner_user_id, doc_id) as owner_user_id, arg_min_null(student_name, doc_id) as student_name, arg_min_null(grade, doc_id) as grade, min(doc_id) as i from submissions group by 1),
b as (select * from one where i % 5 <> 0), dl as (select submission_id, owner_user_id || 'b' as owner_user_id, student_name, '7' as grade from one where i % 3 = 0)
"""
_PATCH = "pat as (select distinct submission_id, case when doc_id % 12 = 0 then 'nobody' else owner_user_id end as owner_user_id from submissions where doc_id % 6 = 0)"
_UP = "up as (select doc_id, case when doc_id % 2 = 0 then owner_user_id else 'src1' end as o, case when doc_id % 3 = 0 then submission_id else 'n' || doc_id end as upload_id from submissions)"
_LINE = "case when doc_id % 7 = 0 then 'ERROR' when doc_id % 5 = 0 then 'WARNING' else 'INFO' end"
ORACLE = {
    "ingest_ids": "select doc_id, substr(sha256(text), 1, 12) as submission_id, strlen(text)::bigint as byte_size from documents",
    "chunk_ids": T.sql("""c as (select doc_id, submission_id, unnest(range(0, doc_id % 3 + 1))::int as chunk_index from submissions), h as (select *, sha256(submission_id || ':' || chunk_index) as h from c)
      select doc_id, chunk_index, substr(h, 1, 12) as chunk_id, submission_id || '_' || chunk_index || '_' || substr(h, 1, 8) as long_id from h""", *_S),
    "scan_records": T.sql("select doc_id, submission_id, filename from submissions where owner_user_id = 'src3' and needs_review", *_S),
    "scan_time_range": T.sql("select doc_id, owner_user_id from submissions where created_at >= timestamp '2024-01-01 02:00:00' and created_at < timestamp '2024-01-01 09:00:00'", *_S),
    "lookup_owned": T.sql("w as (select distinct submission_id, case when doc_id % 8 = 0 then owner_user_id when doc_id % 12 = 0 then 'src0' end as o from submissions where doc_id % 4 = 0) select doc_id, submission_id from submissions where (submission_id, owner_user_id) in (select (submission_id, o) from w where o is not null)", *_S),
    "owner_view": T.sql("select event_id, status from jobs where json_extract_string(payload, '$.k') = '7'", T.JOBS),
    "csv_split_sink": T.sql("select * exclude doc_id from csv", T.SUBMISSIONS, _CSV),
    "csv_counts": T.sql("select split, count(*)::bigint as n from csv group by 1", T.SUBMISSIONS, _CSV),
    "csv_rewrite": T.sql("select submission_id, student_name, school_name, case when doc_id % 4 = 0 then '3' else grade end as grade, word_count, ocr_confidence_avg, review_reason_codes, case when doc_id % 7 = 0 then case split when 'clean' then 'needs_review' else 'clean' end else split end as split from csv where doc_id % 10 <> 0", T.SUBMISSIONS, _CSV),
    "upsert_records": T.sql("""select coalesce(b.submission_id, dl.submission_id) as submission_id, case when dl.submission_id is not null then dl.owner_user_id else b.owner_user_id end as owner_user_id,
      case when dl.submission_id is not null then dl.student_name else b.student_name end as student_name, case when dl.submission_id is not null then dl.grade else b.grade end as grade,
      case when dl.submission_id is null then 'kept' when b.submission_id is not null then 'updated' else 'inserted' end as action, case when dl.submission_id is not null then b.owner_user_id end as previous_owner from b full join dl on b.submission_id = dl.submission_id""", T.SUBMISSIONS, _BASE),
    "patch_records": T.sql("select doc_id, case when (submission_id, owner_user_id) in (select (submission_id, owner_user_id) from pat) then '9' else grade end as grade, doc_class from submissions", T.SUBMISSIONS, _PATCH),
    "delete_owned": T.sql("select doc_id, submission_id from submissions where (submission_id, owner_user_id) not in (select (submission_id, owner_user_id) from pat)", T.SUBMISSIONS, _PATCH),
    "bulk_delete": T.sql("select distinct upload_id as submission_id, case when upload_id in (select submission_id from submissions) then 'deleted' else 'not_found' end as result from up", T.SUBMISSIONS, _UP),
    "export_approved": T.sql("select submission_id, student_name, school_name, grade, filename, strftime(created_at, '%Y-%m-%d') as date from submissions where not needs_review and review_reason_codes = ''", *_S),
    "json_safe": T.sql("select event_id, case when event_id % 10 <> 0 then json_extract_string(payload, '$.k')::double end as k from jobs", T.JOBS),
    "extract_links": """with l as (select page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) as link, generate_subscripts(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1), 1) - 1 as place from pages)
      select page_id, link, min(place)::int as first_place from l where link <> '' group by 1, 2""",
    "log_parse": T.sql(f"select doc_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at, {_LINE} as level, submission_id as job_id, filename from submissions", *_S),
    "path_parse": T.sql("select doc_id, 'in/chunk_' || case when doc_id % 3 <> 0 then (doc_id % 7)::varchar else 'x' end || '_' || submission_id as prefix, case when doc_id % 3 <> 0 then doc_id % 7 end as chunk_index, submission_id from submissions", *_S),
    "run_log_summary": T.sql("select case when doc_id % 6 = 0 then 'failed' else 'ok' end as status, count(*)::bigint as files, count(*) filter (submission_id in (select submission_id from submissions where doc_id % 4 <> 0))::bigint as verified from submissions group by 1", *_S),
    "verify_by_file": T.sql("select filename, count(*)::bigint as chunk_count, count(*) filter (needs_review)::bigint as review, array_to_string(list_sort(list_distinct(list(submission_id))), ',') as ids from submissions group by 1", *_S),
    "verify_saved": T.sql("select doc_id, (submission_id, owner_user_id) in (select (submission_id, owner_user_id) from submissions where doc_id % 4 <> 0) as verified from submissions", *_S),
    "dup_plan": T.sql("select * from planned", T.SUBMISSIONS, _DUPS),
    "dup_upload": T.sql("""i as (select doc_id, o, upload_id as id from up union all select doc_id, o, substr(sha256(upload_id || ':0'), 1, 12) from up), m as (select i.doc_id, max((s.owner_user_id = i.o)::int) as m from i left join submissions s on s.submission_id = i.id group by 1)
      select doc_id, case when m is null then 'new' when m = 1 then 'own_duplicate' else 'other_owner' end as result from m""", T.SUBMISSIONS, _UP),
    "dup_selected": T.sql(f"""sel as (select doc_id from submissions where doc_id % 3 = 0 union all select doc_id + 10000000 from submissions where doc_id % 100 = 0)
      select sel.doc_id, case when s.doc_id is null then 'not_found' when e.doc_id is null then 'not_eligible' when p.action is null then 'no_peers' when p.action = 'keep' then 'newest_kept' else 'delete' end as result
      from sel left join submissions s using (doc_id) left join eligible e on e.doc_id = sel.doc_id left join planned p on p.doc_id = sel.doc_id""", T.SUBMISSIONS, _DUPS),
    "peers_union": T.sql("select doc_id, submission_id from submissions where doc_id % 2 = 0 or doc_id % 3 = 0 or needs_review", *_S),
    "orphans": T.sql("select owner_user_id, count(*)::bigint as folders, sum(word_count)::bigint as bytes from submissions where submission_id not in (select submission_id from submissions where doc_id % 3 <> 0) group by 1", *_S),
    "normalize_join": T.sql("""p as (select distinct submission_id from submissions where doc_id % 2 = 0), i as (select distinct submission_id from submissions where doc_id % 5 <> 0)
      select doc_id, coalesce(school_name, case when p.submission_id is not null then 'from artifact' end) as school, coalesce(nullif(word_count, 0), case when p.submission_id is not null then 11 end) as words, i.submission_id is null as artifact_missing
      from submissions s left join p on p.submission_id = s.submission_id left join i on i.submission_id = s.submission_id""", *_S),
    "readers_merge_all": T.sql("k as (select distinct lower(email) as email from readers) select email, 'known' as origin from k union all select distinct lower(reader_email), 'created' from rankings where lower(reader_email) not in (select email from k)", T.READERS, T.RANKINGS),
    "batch_defaults": T.sql(f"""j as (select s.*, n_name as ds, case when n_nationkey % 2 = 0 then '4' end as dg from submissions s left join (select * from nation where n_nationkey < 8) n on n.n_nationkey = s.batch_id),
      f as (select *, school_source <> 'manual' and coalesce(trim(school_name), '') = '' and coalesce(trim(ds), '') <> '' as s, school_source <> 'manual' and coalesce(trim(grade), '') = '' and coalesce(trim(dg), '') <> '' as g from j)
      select doc_id, case when s then trim(ds) else school_name end as school_name, case when g then trim(dg) else grade end as grade, case when s then 'batch_default' else school_source end as school_source,
        array_to_string(list_filter(list_sort(list_distinct(string_split(review_reason_codes, ';'))), lambda x: x <> '' and not (s and x = 'MISSING_SCHOOL_NAME') and not (g and x = 'MISSING_GRADE')), ';') as review_reason_codes, s or g as updated from f""", *_S),
    "artifact_index": T.sql(f"""m as (select doc_id, array_to_string(list_filter({list(sorted(ARTIFACTS))}, lambda a: (length(a) + doc_id) % 4 = 0), ',') as missing from submissions) select doc_id, missing, missing <> '' as artifact_missing from m""", *_S),
    "reingest": T.sql("select * from (select doc_id, submission_id, owner_user_id, lag(owner_user_id) over (partition by submission_id order by created_at, doc_id) as previous_owner from submissions) where previous_owner is not null", *_S),
    "reextract_diff": T.sql(rf"""t as (select doc_id, school_name as raw, grade, {R._GRADE} as g from submissions),
      u as (select *, array_to_string(list_filter(regexp_split_to_array(regexp_replace(raw, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '[\x09-\x0D\x20]+'), lambda x: x <> ''), ' ') as sc from t),
      v as (select *, array_to_string(list_transform(string_split(sc, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as shown from u)
      select doc_id, 'grade' as field, grade as before, g as after from v where grade is distinct from g union all select doc_id, 'school_name', raw, shown from v where raw is distinct from shown""", *_S),
}
ORACLE["readers_merge"] = ORACLE["readers_merge_all"]
