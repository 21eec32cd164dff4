"""Counts, rates, histograms and comparisons of runs.

Each report is one aggregation (partial sums before the shuffle) or two levels of them; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.plans import tables as T


def status_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.count_if(~F.col("needs_review")).alias("clean"), F.count_if(F.col("needs_review")).alias("review"))


def owner_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("owner_user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("needs_review")).alias("review"),
        F.count_distinct("school_name").alias("schools"),
        F.count_distinct("grade").alias("grades"),
        F.avg("word_count").alias("avg_words"),
    )


def by_field(records: DataFrame, field: str) -> DataFrame:
    return records.groupBy(field).agg(F.count("*").alias("total"), F.count_if(F.col("needs_review")).alias("review")).orderBy(F.desc("total"), field)


def top_owners(records: DataFrame, n: int = 10) -> DataFrame:
    return records.groupBy("owner_user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner_user_id").limit(n)


def _code_list(records: DataFrame, known: bool = True) -> DataFrame:
    return records.withColumn("code", F.explode(X.codes_norm(F.col("review_reason_codes"), enum_only=known)))


def reason_stats(records: DataFrame) -> DataFrame:
    """Rows by state and by code, as (kind, code, n). A record with all data and no codes counts as approved."""
    full = (F.coalesce("student_name", F.lit("")) != "") & (F.coalesce("school_name", F.lit("")) != "") & (F.coalesce("grade", F.lit("")) != "")
    state = F.when(full & (F.col("review_reason_codes") == ""), "approved").when(~F.col("needs_review"), "approved").when(F.col("review_reason_codes") == "", "no_code").otherwise("review")
    rows = records.withColumn("kind", state)
    states = rows.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit("").alias("code"), "n")
    codes = _code_list(rows.where("kind = 'review'")).groupBy("code").agg(F.count("*").alias("n")).select(F.lit("code").alias("kind"), "code", "n")
    return states.unionByName(codes)


def dup_filenames(records: DataFrame, n: int = 12) -> DataFrame:
    """The n most repeated file names; long ones are cut to 80 characters."""
    name = F.coalesce(F.nullif(X.trimmed(F.col("filename")), F.lit("")), F.lit("(no filename)"))
    counts = records.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "name").limit(n)
    return counts.select(F.when(F.length("name") <= 80, F.col("name")).otherwise(F.concat(F.substring("name", 1, 77), F.lit("..."))).alias("filename"), "n")


def school_grade_groups(records: DataFrame) -> DataFrame:
    """Buckets of reviewed records by normalized school and grade, with the spelling seen first."""
    key = X.norm_key(F.col("school_name"))
    ready = records.where(~F.col("needs_review") & (key != "") & (F.coalesce(X.trimmed(F.col("grade")), F.lit("")) != ""))
    groups = ready.groupBy(key.alias("school_key"), F.trim("grade").alias("grade")).agg(F.count("*").alias("n"), F.min_by(X.trimmed(F.col("school_name")), "doc_id").alias("first_spelling"))
    return groups


def approved_counts(records: DataFrame) -> DataFrame:
    """Approved records per school and grade and per grade, with their owners, in one pass of grouping sets."""
    rows = records.where("not needs_review and school_name is not null and grade is not null").withColumn("school_key", X.norm_key(F.col("school_name")))
    return rows.groupingSets([["school_key", "grade"], ["grade"]], "school_key", "grade").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("owner_user_id")), ";").alias("owners"), F.grouping("school_key").cast("int").alias("all_schools")
    )


def parent_rollup(records: DataFrame) -> DataFrame:
    """State of parents from their children: any in review, all codes."""
    return (
        records.where("parent_submission_id is not null")
        .groupBy("parent_submission_id")
        .agg(
            F.bool_or("needs_review").alias("needs_review"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.codes_norm(F.col("review_reason_codes")))))), ";").alias("codes"),
        )
    )


def is_container() -> Column:
    return X.doc_role(F.col("is_chunk"), F.col("is_container_parent"), F.lit(""), F.col("doc_class")) == "container"


def run_summary(records: DataFrame) -> DataFrame:
    """Totals and rates of a run; containers are counted apart."""
    doc = ~is_container()
    has = lambda code: F.array_contains(F.split("review_reason_codes", ";"), code)
    return records.agg(
        F.count_if(doc).alias("docs"),
        F.count_if(~doc).alias("containers"),
        F.count_if(doc & F.col("needs_review")).alias("reviewed"),
        F.avg(F.when(doc, F.col("needs_review").cast("int"))).alias("review_rate"),
        F.avg(F.when(doc, F.col("ocr_confidence_avg"))).alias("ocr_confidence"),
        F.count_if(doc & has("OCR_LOW_CONFIDENCE")).alias("low_confidence"),
        F.count_if(doc & has("EMPTY_ESSAY")).alias("empty_essays"),
        F.avg(F.when(doc, F.col("grade").isNotNull().cast("int"))).alias("grade_found_rate"),
        F.avg(F.when(doc, F.col("school_name").isNotNull().cast("int"))).alias("school_found_rate"),
    )


def review_rate_by_type(records: DataFrame) -> DataFrame:
    return records.where(~is_container()).groupBy("doc_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("needs_review")).alias("review"), F.avg(F.col("needs_review").cast("int")).alias("review_rate")
    )


def ops_summary(records: DataFrame) -> DataFrame:
    """By document class: records, review rate, suspicious names, and empty essays that have text or confidence after all."""
    empty = F.array_contains(F.split("review_reason_codes", ";"), "EMPTY_ESSAY")
    wrong = empty & ((F.col("word_count") * 6 > 200) | (F.col("ocr_confidence_avg") >= 0.7))
    return records.groupBy("doc_class").agg(
        F.count("*").alias("total"),
        F.avg(F.col("needs_review").cast("int")).alias("review_rate"),
        F.count_if(X.suspicious_name(F.col("student_name"))).alias("suspicious_names"),
        F.coalesce(F.try_divide(F.count_if(wrong), F.count_if(empty)), F.lit(0.0)).alias("false_empty_rate"),
    )


def reason_pairs(records: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent pairs of codes on one record. A record holds at most a handful of codes."""
    c = X.codes_norm(F.col("review_reason_codes"))
    pairs = F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return records.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(n)


BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01))


def conf_hist(records: DataFrame) -> DataFrame:
    """Histogram of three confidence measures per format, bins without records included."""
    spark = records.sparkSession
    c = F.col("ocr_confidence_avg")
    measures = records.select("format", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in (("avg", c), ("min", c * 0.8), ("p10", F.when(F.col("doc_id") % 5 != 0, c * 0.9)))])).alias("m"))
    value = F.col("m.value")
    label = F.when(value.isNull(), "unknown").otherwise(F.coalesce(*[F.when((value >= lo) & (value < hi), f"{lo:.1f}-{min(hi, 1.0):.1f}") for lo, hi in BINS], F.lit("unknown")))
    counts = measures.groupBy("format", F.col("m.measure").alias("measure"), label.alias("bin")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(f"{lo:.1f}-{min(hi, 1.0):.1f}",) for lo, hi in BINS] + [("unknown",)], "bin string")
    grid = counts.select("format", "measure").distinct().join(F.broadcast(names))
    return grid.join(counts, ["format", "measure", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def chunk_dist(records: DataFrame) -> DataFrame:
    """How many parents have how many chunks."""
    parents = records.groupBy(F.coalesce("parent_submission_id", "submission_id").alias("parent")).agg(F.count("*").alias("chunks"))
    return parents.groupBy("chunks").agg(F.count("*").alias("parents"))


def oversplit(records: DataFrame, pages: int = 6, chunks: int = 4, ratio: float = 1.2) -> DataFrame:
    """Mean pages per chunk of long bundles, and whether that hints at splitting too much. The page count seen last holds."""
    parents = records.groupBy(F.coalesce("parent_submission_id", "filename").alias("parent")).agg(F.count("*").alias("chunks"), F.max_by("page_count", "doc_id").alias("pages"))
    return parents.where((F.col("pages") >= pages) & (F.col("chunks") >= chunks)).agg(F.avg(F.col("pages") / F.col("chunks")).alias("pages_per_chunk"), F.count("*").alias("bundles")).withColumn("candidate", F.coalesce(F.col("pages_per_chunk") <= ratio, F.lit(False)))


def parse_matrix(records: DataFrame) -> DataFrame:
    """Successes and failures of parsing by method and confidence bucket."""
    rows = records.withColumn("bucket", X.conf_bucket(F.col("ocr_confidence_avg"))).withColumn("ok", F.when(F.col("needs_review"), "failed").otherwise("parsed"))
    return rows.groupBy("extraction_method", "bucket").pivot("ok", ["parsed", "failed"]).agg(F.count(F.lit(1))).na.fill(0, ["parsed", "failed"])


def fail_by_method(records: DataFrame) -> DataFrame:
    return records.groupBy("extraction_method").agg(F.count("*").alias("n"), F.avg(F.col("needs_review").cast("int")).alias("failure_rate"), F.avg("word_count").alias("avg_words"))


def high_conf_fail(records: DataFrame, floor: float = 0.85, n: int = 25) -> DataFrame:
    """The first n failures at high confidence, a report of samples."""
    return records.where((F.col("ocr_confidence_avg") >= floor) & F.col("needs_review")).orderBy("doc_id").limit(n)


def stage_timing(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("doc_class", "status").agg(
        F.count("*").alias("n"), F.avg("processing_ms").alias("avg_ms"), F.max("processing_ms").alias("max_ms"), F.avg("queue_wait_ms").alias("avg_wait_ms")
    )


def snapshot(records: DataFrame) -> DataFrame:
    """A run's figures in long form: (figure, key, value)."""
    doc = records.where(~is_container())
    rates = review_rate_by_type(records).select(F.lit("review_rate").alias("figure"), F.col("doc_type").alias("key"), F.col("review_rate").alias("value"))
    codes = _code_list(doc).groupBy("code").agg(F.count("*").cast("double").alias("value")).select(F.lit("reason_code").alias("figure"), F.col("code").alias("key"), "value")
    totals = doc.agg(F.avg("ocr_confidence_avg").alias("o"), F.avg(F.col("is_chunk").cast("int")).alias("c"))
    totals = totals.select(F.explode(F.array(F.struct(F.lit("ocr_confidence").alias("figure"), F.lit("").alias("key"), F.col("o").alias("value")), F.struct(F.lit("chunk_rate").alias("figure"), F.lit("").alias("key"), F.col("c").alias("value")))).alias("r")).select("r.*")
    return rates.unionByName(codes).unionByName(totals)


LIMITS = {"review_rate": 0.10, "ocr_confidence": -0.05, "chunk_rate": -0.03}


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Figures of the current run that moved beyond their limits, and codes that are new."""
    joined = current.join(baseline.select("figure", "key", F.col("value").alias("before")), ["figure", "key"], "left")
    change = F.col("value") - F.coalesce("before", F.lit(0.0))
    bad = F.when(F.col("figure") == "reason_code", F.col("before").isNull())
    for figure, limit in LIMITS.items():
        bad = bad.when(F.col("figure") == figure, change > limit if limit > 0 else change < limit)
    return joined.withColumn("change", change).where(bad).select("figure", "key", "change")


def reason_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Counts of every code of either run and their difference."""
    count = lambda df, name: _code_list(df).groupBy("code").agg(F.count("*").alias(name))
    both = count(current, "now").join(count(baseline, "before"), "code", "full").na.fill(0, ["now", "before"])
    return both.withColumn("delta", F.col("now") - F.col("before"))


def cost_drivers(pages: DataFrame, n: int = 10) -> DataFrame:
    """The n documents with most pages."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "doc_id").limit(n)


def improved_docs(old: DataFrame, new: DataFrame, code: str) -> DataFrame:
    """Documents that had a code in the old run and have it no more."""
    has = F.array_contains(X.codes_norm(F.col("review_reason_codes")), code)
    return old.where(has).join(new.where(~has).select("doc_id"), "doc_id").select("doc_id")


def filter_options(records: DataFrame) -> DataFrame:
    """Distinct values to filter by, as (option, value)."""
    fields = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("option"), F.col(c).cast("string").alias("value")) for k, c in (("school", "school_name"), ("grade", "grade"), ("batch", "batch_id"))])).alias("o")).select("o.*")
    reasons = _code_list(records).select(F.lit("reason").alias("option"), F.col("code").alias("value"))
    return fields.unionByName(reasons).where("value is not null and value <> ''").distinct()


def grade_orders(records: DataFrame) -> DataFrame:
    """Distinct grades with their place in the three orders in use: numbers first, digits as text, text first."""
    from pyspark.sql import Window

    g = records.where("grade is not null").select("grade").distinct()
    value = F.when(F.col("grade").rlike(r"^\d+$"), F.col("grade").cast("int"))
    place = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  over the few distinct grades
    return g.select("grade", place(value.isNull(), value, F.lower("grade"), "grade").alias("numeric_first"), place(value.isNull(), F.lower("grade"), "grade").alias("digits_as_text"), place(value.isNotNull(), F.lower("grade"), value, "grade").alias("text_first"))


def _runs(s, d):
    r = T.submissions(s, d)
    old = r.where("doc_id % 3 <> 0").withColumn("review_reason_codes", F.when(F.col("doc_id") % 2 == 0, F.replace("review_reason_codes", F.lit("SHORT_ESSAY"), F.lit(""))).otherwise(F.col("review_reason_codes"))).where("not contains(review_reason_codes, 'MISSING_GRADE')")
    return r.where("doc_id % 3 <> 1"), old


def _paged(s, d):
    return T.submissions(s, d).withColumn("page_count", F.when(F.col("doc_id") % 8 != 0, F.col("doc_id") % 9))


def _q(f):
    return lambda s, d: f(T.submissions(s, d))


QUERIES = {
    "status_counts": _q(status_counts),
    "owner_stats": _q(owner_stats),
    "by_grade": _q(lambda r: by_field(r, "grade")),
    "by_school": _q(lambda r: by_field(r, "school_name")),
    "top_owners": _q(top_owners),
    "reason_stats": _q(reason_stats),
    "dup_filenames": _q(dup_filenames),
    "school_grade_groups": _q(school_grade_groups),
    "approved_by_school_grade": _q(lambda r: approved_counts(r).where("all_schools = 0").drop("all_schools")),
    "approved_by_grade": _q(lambda r: approved_counts(r).where("all_schools = 1").drop("all_schools", "school_key")),
    "parent_rollup": _q(parent_rollup),
    "run_summary": _q(run_summary),
    "review_rate_by_type": _q(review_rate_by_type),
    "ops_summary": _q(ops_summary),
    "reason_pairs": _q(reason_pairs),
    "conf_hist": _q(conf_hist),
    "chunk_dist": _q(chunk_dist),
    "oversplit": lambda s, d: oversplit(_paged(s, d)),
    "parse_matrix": _q(parse_matrix),
    "fail_by_method": _q(fail_by_method),
    "high_conf_fail": _q(lambda r: high_conf_fail(r).select("doc_id", "ocr_confidence_avg")),
    "stage_timing": lambda s, d: stage_timing(T.metrics(s, d)),
    "snapshot": _q(snapshot),
    "drift": lambda s, d: drift(*map(snapshot, _runs(s, d))),
    "reason_delta": lambda s, d: reason_delta(*_runs(s, d)),
    "cost_drivers": lambda s, d: cost_drivers(T.pages(s, d)),
    "improved_docs": lambda s, d: improved_docs(T.submissions(s, d), _runs(s, d)[1], "SHORT_ESSAY"),
    "filter_options": _q(filter_options),
    "grade_orders": _q(grade_orders),
}

_S = (T.SUBMISSIONS,)
_CODES = f"list_distinct(list_filter(string_split(review_reason_codes, ';'), lambda x: x in ({', '.join(repr(c) for c in X.ENUM)})))"
_ALL = "list_sort(list_distinct(list_filter(string_split(review_reason_codes, ';'), lambda x: x <> '')))"
_TR = r"regexp_replace({}, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')"
_NK = r"replace(lower(regexp_replace(" + _TR.format("coalesce(school_name, '')") + r", '[\x09-\x0D\x20]+', ' ', 'g')), 'ß', 'ss')"
_CONTAINER = "(not is_chunk and (is_container_parent or doc_class = 'BULK_SCANNED_BATCH'))"
_HAS = "list_contains(string_split(review_reason_codes, ';'), '{}')"
_NAME = r"list_filter(regexp_split_to_array(coalesce(student_name, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')"
SNAP = """
doc_{0} as (select * from run_{0} where not {1}),
snap_{0} as (select 'review_rate' as figure, doc_type as key, avg(needs_review::int) as value from doc_{0} group by 2
  union all select 'reason_code', code, count(*)::double from (select unnest({2}) as code from doc_{0}) group by 2
  union all select 'ocr_confidence', '', avg(ocr_confidence_avg) from doc_{0} union all select 'chunk_rate', '', avg(is_chunk::int) from doc_{0})
"""
RUNS = """
run_now as (select * from submissions where doc_id % 3 <> 1),
run_old as (select * from (select * replace (case when doc_id % 2 = 0 then replace(review_reason_codes, 'SHORT_ESSAY', '') else review_reason_codes end as review_reason_codes)
  from submissions where doc_id % 3 <> 0) where not contains(review_reason_codes, 'MISSING_GRADE'))
"""


def _snap(name):
    return SNAP.format(name, _CONTAINER, _CODES)


ORACLE = {
    "status_counts": T.sql("select count(*)::bigint as total, count(*) filter (not needs_review)::bigint as clean, count(*) filter (needs_review)::bigint as review from submissions", *_S),
    "owner_stats": T.sql("select owner_user_id, count(*)::bigint as total, count(*) filter (needs_review)::bigint as review, count(distinct school_name)::bigint as schools, count(distinct grade)::bigint as grades, avg(word_count) as avg_words from submissions group by 1", *_S),
    "by_grade": T.sql("select grade, count(*)::bigint as total, count(*) filter (needs_review)::bigint as review from submissions group by 1", *_S),
    "by_school": T.sql("select school_name, count(*)::bigint as total, count(*) filter (needs_review)::bigint as review from submissions group by 1", *_S),
    "top_owners": T.sql("select owner_user_id, count(*)::bigint as n from submissions group by 1 order by n desc, 1 limit 10", *_S),
    "reason_stats": T.sql(f"""t as (select *, case when coalesce(student_name, '') <> '' and coalesce(school_name, '') <> '' and coalesce(grade, '') <> '' and review_reason_codes = '' then 'approved'
        when not needs_review then 'approved' when review_reason_codes = '' then 'no_code' else 'review' end as kind from submissions)
      select kind, '' as code, count(*)::bigint as n from t group by 1 union all select 'code', code, count(*)::bigint from (select unnest({_CODES}) as code from t where kind = 'review') group by 2""", *_S),
    "dup_filenames": T.sql("select case when length(name) <= 80 then name else substr(name, 1, 77) || '...' end as filename, n from (select coalesce(nullif(trim(filename), ''), '(no filename)') as name, count(*)::bigint as n from submissions group by 1 having count(*) >= 2 order by n desc, name limit 12)", *_S),
    "school_grade_groups": T.sql(f"select {_NK} as school_key, trim(grade) as grade, count(*)::bigint as n, arg_min({_TR.format('school_name')}, doc_id) as first_spelling from submissions where not needs_review and {_NK} <> '' and coalesce(trim(grade), '') <> '' group by 1, 2", *_S),
    "approved_by_school_grade": T.sql(f"select {_NK} as school_key, grade, count(*)::bigint as n, array_to_string(list_sort(list_distinct(list(owner_user_id))), ';') as owners from submissions where not needs_review and school_name is not null and grade is not null group by 1, 2", *_S),
    "approved_by_grade": T.sql("select grade, count(*)::bigint as n, array_to_string(list_sort(list_distinct(list(owner_user_id))), ';') as owners from submissions where not needs_review and school_name is not null and grade is not null group by 1", *_S),
    "parent_rollup": T.sql(f"select parent_submission_id, bool_or(needs_review) as needs_review, array_to_string(list_sort(list_distinct(flatten(list({_ALL})))), ';') as codes from submissions where parent_submission_id is not null group by 1", *_S),
    "run_summary": T.sql(f"""t as (select *, not {_CONTAINER} as doc from submissions) select count(*) filter (doc)::bigint as docs, count(*) filter (not doc)::bigint as containers, count(*) filter (doc and needs_review)::bigint as reviewed,
      avg(needs_review::int) filter (doc) as review_rate, avg(ocr_confidence_avg) filter (doc) as ocr_confidence, count(*) filter (doc and {_HAS.format('OCR_LOW_CONFIDENCE')})::bigint as low_confidence,
      count(*) filter (doc and {_HAS.format('EMPTY_ESSAY')})::bigint as empty_essays, avg((grade is not null)::int) filter (doc) as grade_found_rate, avg((school_name is not null)::int) filter (doc) as school_found_rate from t""", *_S),
    "review_rate_by_type": T.sql(f"select doc_type, count(*)::bigint as total, count(*) filter (needs_review)::bigint as review, avg(needs_review::int) as review_rate from submissions where not {_CONTAINER} group by 1", *_S),
    "ops_summary": T.sql(f"""t as (select *, {_NAME} as w, {_HAS.format('EMPTY_ESSAY')} as empty from submissions), u as (select *, list_filter(w, lambda x: regexp_matches(x, '\\pL')) as l from t)
      select doc_class, count(*)::bigint as total, avg(needs_review::int) as review_rate, count(*) filter (len(w) > 5 or len(list_filter(w, lambda x: lower(regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g')) in ({', '.join(repr(v) for v in X.VERBS)}))) > 0
          or coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / nullif(len(l), 0)::double < 0.4, false))::bigint as suspicious_names,
        coalesce(count(*) filter (empty and (word_count * 6 > 200 or ocr_confidence_avg >= 0.7)) / nullif(count(*) filter (empty), 0)::double, 0) as false_empty_rate from u group by 1""", *_S),
    "reason_pairs": T.sql(f"c as (select doc_id, unnest({_ALL}) as code from submissions) select x.code as a, y.code as b, count(*)::bigint as n from c x join c y on x.doc_id = y.doc_id and x.code < y.code group by 1, 2 order by n desc, a, b limit 20", *_S),
    "conf_hist": T.sql("""m as (select format, 'avg' as measure, ocr_confidence_avg as v from submissions union all select format, 'min', ocr_confidence_avg * 0.8 from submissions union all select format, 'p10', case when doc_id % 5 <> 0 then ocr_confidence_avg * 0.9 end from submissions),
      b as (select * from (values (0.0, 0.2, '0.0-0.2'), (0.2, 0.4, '0.2-0.4'), (0.4, 0.6, '0.4-0.6'), (0.6, 0.8, '0.6-0.8'), (0.8, 1.01, '0.8-1.0'), (null, null, 'unknown')) t(lo, hi, bin))
      select k.format, k.measure, b.bin, count(m.format)::bigint as n from (select distinct format, measure from m) k cross join b
      left join m on m.format = k.format and m.measure = k.measure and (case when b.bin = 'unknown' then m.v is null else m.v >= b.lo::double and m.v < b.hi::double end) group by 1, 2, 3""", *_S),
    "chunk_dist": T.sql("select chunks, count(*)::bigint as parents from (select coalesce(parent_submission_id, submission_id) as p, count(*)::bigint as chunks from submissions group by 1) group by 1", *_S),
    "oversplit": T.sql("""t as (select *, case when doc_id % 8 <> 0 then doc_id % 9 end as page_count from submissions), p as (select coalesce(parent_submission_id, filename) as parent, count(*) as chunks, arg_max_null(page_count, doc_id) as pages from t group by 1)
      select avg(pages / chunks) as pages_per_chunk, count(*)::bigint as bundles, coalesce(avg(pages / chunks) <= 1.2, false) as candidate from p where pages >= 6 and chunks >= 4""", *_S),
    "parse_matrix": T.sql("select extraction_method, case when ocr_confidence_avg < 0.5 then 'low' when ocr_confidence_avg < 0.75 then 'medium' else 'high' end as bucket, count(*) filter (not needs_review)::bigint as parsed, count(*) filter (needs_review)::bigint as failed from submissions group by 1, 2", *_S),
    "fail_by_method": T.sql("select extraction_method, count(*)::bigint as n, avg(needs_review::int) as failure_rate, avg(word_count) as avg_words from submissions group by 1", *_S),
    "high_conf_fail": T.sql("select doc_id, ocr_confidence_avg from submissions where ocr_confidence_avg >= 0.85 and needs_review order by doc_id limit 25", *_S),
    "stage_timing": T.sql("select doc_class, status, count(*)::bigint as n, avg(processing_ms) as avg_ms, max(processing_ms) as max_ms, avg(queue_wait_ms) as avg_wait_ms from metrics group by 1, 2", T.METRICS),
    "snapshot": T.sql("select * from snap_all", T.SUBMISSIONS, "run_all as (select * from submissions)", _snap("all")),
    "drift": T.sql("""j as (select n.*, n.value - coalesce(o.value, 0) as change, o.value as before from snap_now n left join snap_old o on o.figure = n.figure and o.key = n.key)
      select figure, key, change from j where case figure when 'reason_code' then before is null when 'review_rate' then change > 0.1 when 'ocr_confidence' then change < -0.05 else change < -0.03 end""", T.SUBMISSIONS, RUNS, _snap("now"), _snap("old")),
    "reason_delta": T.sql(f"""a as (select code, count(*)::bigint as now from (select unnest({_CODES}) as code from run_now) group by 1), b as (select code, count(*)::bigint as before from (select unnest({_CODES}) as code from run_old) group by 1)
      select code, coalesce(now, 0) as now, coalesce(before, 0) as before, coalesce(now, 0) - coalesce(before, 0) as delta from a full join b using (code)""", T.SUBMISSIONS, RUNS),
    "cost_drivers": T.sql("select doc_id, count(*)::bigint as pages from doc_pages group by 1 order by pages desc, doc_id limit 10", T.PAGES),
    "improved_docs": T.sql(f"select s.doc_id from submissions s join run_old r on r.doc_id = s.doc_id where list_contains(string_split(s.review_reason_codes, ';'), 'SHORT_ESSAY') and not list_contains(string_split(r.review_reason_codes, ';'), 'SHORT_ESSAY')", T.SUBMISSIONS, RUNS),
    "filter_options": T.sql(f"""o as (select 'school' as option, school_name as value from submissions union all select 'grade', grade from submissions union all select 'batch', batch_id::varchar from submissions union all select 'reason', unnest({_CODES}) from submissions)
      select distinct option, value from o where value is not null and value <> ''""", *_S),
    "grade_orders": T.sql(r"""g as (select distinct grade, case when regexp_full_match(grade, '\d+') then grade::int end as v from submissions where grade is not null)
      select grade, row_number() over (order by v is null, v nulls first, lower(grade), grade)::int as numeric_first, row_number() over (order by v is null, lower(grade), grade)::int as digits_as_text,
        row_number() over (order by v is not null, lower(grade), v nulls first, grade)::int as text_first from g""", *_S),
}
