"""Pages and chunks of documents, and where on their pages field values come from.

Pages are a long table (doc_id, page_index, text); windows and joins all have the document as key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.plans import tables as T


def described(pages: DataFrame) -> DataFrame:
    """pages with header scores, characters and a format of their own."""
    return pages.withColumns(
        {
            "score": X.header_score(F.col("text")),
            "relaxed": X.header_score(F.col("text"), True),
            "chars": F.length("text"),
            "has_text": F.length("text") >= 200,
            "confidence": (F.length("text") % 100) / 100.0,
        }
    )


def doc_format(pages: DataFrame) -> DataFrame:
    """native_text, image_only or hybrid, from the pages that have a text layer."""
    return pages.groupBy("doc_id").agg(
        F.when(F.bool_and("has_text"), "native_text").when(~F.bool_or("has_text"), "image_only").otherwise("hybrid").alias("format"), F.count("*").alias("pages")
    )


def start_pages(pages: DataFrame) -> DataFrame:
    """pages with format and is_start: a page that looks like a form's first; the first page always is one."""
    scanned = F.col("format") != "native_text"
    looks = F.when(scanned, (F.col("relaxed") >= 0.15) & (F.col("chars") >= 5)).otherwise((F.col("score") >= 0.2) & (F.col("chars") >= 10))
    first = Window.partitionBy("doc_id")
    return pages.join(doc_format(pages), "doc_id").withColumn("is_start", looks | (F.col("page_index") == F.min("page_index").over(first)))


def periodic_starts(starts: DataFrame) -> DataFrame:
    """Starts of long scanned documents with a single one: every second page with some header, if there is another."""
    doc = Window.partitionBy("doc_id")
    place = F.col("page_index") - F.min("page_index").over(doc)
    candidate = (place % 2 == 0) & ((place == 0) | ((F.col("relaxed") >= 0.1) & (F.col("chars") >= 3)))
    marked = starts.withColumn("__c", candidate).withColumn("__n", F.count_if(F.col("is_start")).over(doc)).withColumn("__k", F.count_if(F.col("__c")).over(doc))
    use = (F.col("format") != "native_text") & (F.col("pages") >= 6) & (F.col("__n") == 1) & (F.col("__k") >= 2)
    return marked.withColumn("is_start", F.when(use, F.col("__c")).otherwise(F.col("is_start"))).drop("__c", "__n", "__k")


def band_refine(starts: DataFrame, top: float = 0.15) -> DataFrame:
    """Starts (with bands, an array of y0 and y1 from 0 at the top to 1) of scanned documents whose four pages or more all count as starts.

    If two pages or more have a dark band near their top, only these and the first page stay starts. Documents of low confidence
    throughout are left as they are.
    """
    doc = Window.partitionBy("doc_id")
    scanned = F.col("format") != "native_text"
    marked = starts.withColumn("__d", F.coalesce(F.exists("bands", lambda b: b["y0"] < top), F.lit(False))).withColumns(
        {
            "__all": F.bool_and("is_start").over(doc) & (F.col("pages") >= 4) & scanned & ~F.bool_and(F.col("confidence") < 0.35).over(doc),
            "__n": F.count_if(F.col("__d")).over(doc),
            "__first": F.col("page_index") == F.min("page_index").over(doc),
        }
    )
    use = F.col("__all") & (F.col("__n") >= 2)
    return marked.withColumn("is_start", F.when(use, F.col("__first") | F.col("__d")).otherwise(F.col("is_start"))).drop("__d", "__all", "__n", "__first")


def chunk_ranges(starts: DataFrame) -> DataFrame:
    """Each start page runs to the page before the next."""
    last = starts.groupBy("doc_id").agg(F.max("page_index").alias("__last"))
    order = Window.partitionBy("doc_id").orderBy("page_index")
    rows = starts.where("is_start").join(last, "doc_id")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), F.col("page_index").alias("start_page"), F.coalesce(F.lead("page_index").over(order) - 1, "__last").alias("end_page"))


def doc_structure(starts: DataFrame) -> DataFrame:
    """single, multi or template; scanned documents of low confidence throughout are single."""
    blank = F.col("text").rlike("(?i)^student name grade school essay") & (F.col("chars") < 150)
    return starts.groupBy("doc_id").agg(
        F.when(F.bool_and((F.col("format") != "native_text") & (F.col("confidence") < 0.35)), "single")
        .when(F.bool_and(blank), "template")
        .when(F.count_if(F.col("is_start")) > 1, "multi")
        .otherwise("single")
        .alias("structure")
    )


def bulk_heuristic(starts: DataFrame) -> DataFrame:
    """A bulk batch: several pages, at least two with a name label, and headers on two of the first three."""
    anchor = F.lower("text").contains("student name")
    place = F.col("page_index") - F.min("page_index").over(Window.partitionBy("doc_id"))
    return starts.withColumn("__p", place).groupBy("doc_id").agg(
        ((F.count("*") > 1) & (F.count_if(anchor) >= 2) & (F.count_if((F.col("__p") < 3) & (F.col("score") >= 0.2)) >= 2)).alias("bulk")
    )


def alternating_pages(starts: DataFrame) -> DataFrame:
    """Even numbers of pages whose odd ones score clearly less than their even ones."""
    place = F.col("page_index") - F.min("page_index").over(Window.partitionBy("doc_id"))
    even = F.avg(F.when(F.col("__p") % 2 == 0, F.col("relaxed")))
    odd = F.avg(F.when(F.col("__p") % 2 == 1, F.col("relaxed")))
    n = F.count("*")
    return starts.withColumn("__p", place).groupBy("doc_id").agg(F.coalesce((n >= 4) & (n % 2 == 0) & (even > 0) & (odd < even * 1.15), F.lit(False)).alias("alternating"))


def range_plan(starts: DataFrame) -> DataFrame:
    """Page ranges to process: pairs where pages alternate, else one page each, counted from 0."""
    docs = starts.groupBy("doc_id").agg(F.count("*").alias("n")).join(alternating_pages(starts), "doc_id")
    step = F.when(F.col("alternating"), 2).otherwise(1)
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long"))).alias("start_page"), step.alias("step")).select("doc_id", "start_page", (F.col("start_page") + F.col("step") - 1).alias("end_page"))


def header_peaks(pages: DataFrame, floor: float = 0.2) -> DataFrame:
    """Whether at least two pages have a local maximum of the header score."""
    order = Window.partitionBy("doc_id").orderBy("page_index")
    s = F.col("score")
    peak = (s >= floor) & (s > F.coalesce(F.lag("score").over(order), F.lit(-1.0))) & (s >= F.coalesce(F.lead("score").over(order), F.lit(-1.0)))
    return pages.withColumn("__peak", peak).groupBy("doc_id").agg((F.count_if(F.col("__peak")) >= 2).alias("several_peaks"))


def page_coverage(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages that no chunk or several cover, and covered pages that are not there."""
    hit = ranges.select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_index")).groupBy("doc_id", "page_index").agg(F.count("*").alias("times"))
    both = pages.select("doc_id", "page_index", F.lit(True).alias("__p")).join(hit, ["doc_id", "page_index"], "full")
    return both.where("__p is null or times is null or times <> 1").select("doc_id", "page_index", F.coalesce("times", F.lit(0)).alias("times"))


def conf_stats(pages: DataFrame, low: float = 0.65) -> DataFrame:
    """Least and tenth-percentile confidence (by rank, not interpolated) and the number of low pages."""
    doc = Window.partitionBy("doc_id")
    ranked = pages.withColumn("__r", F.row_number().over(doc.orderBy("confidence"))).withColumn("__n", F.count("*").over(doc))
    at = F.greatest(F.floor(F.col("__n") * 0.1), F.lit(1))
    return ranked.groupBy("doc_id").agg(F.min("confidence").alias("least"), F.max(F.when(F.col("__r") == at, F.col("confidence"))).alias("p10"), F.count_if(F.col("confidence") < low).alias("low_pages"))


def assemble_text(pages: DataFrame) -> DataFrame:
    """Texts of a document's pages in order; null if one of several pages is blank."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(F.when((F.count("*") > 1) & F.bool_or(blank), None).otherwise(joined).alias("text"))


def page_source(docs: DataFrame) -> DataFrame:
    """Pages of each document from the first of three lists that has any; pages without a valid number are dropped."""
    lists = ("summary", "ocr_pages", "pages")
    chosen = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in lists])
    rows = docs.select("doc_id", F.explode(chosen).alias("p"))
    return rows.select("doc_id", F.col("p.page_index").try_cast("int").alias("page_index"), F.col("p.text").alias("text")).where("page_index is not null")


# Attribution.


def attributed(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """fields (doc_id, field, value, start_page, end_page) with the earliest page of their range that holds the value.

    An equi-join on the document with the page range as a residual. Exact hits count 1, normalized ones 0.9.
    """
    p = pages.select("doc_id", "page_index", "text", X.norm_match(F.col("text")).alias("norm"))
    needle = X.norm_match(F.col("value"))
    hits = fields.join(p, "doc_id").where(F.col("page_index").between(F.col("start_page"), F.col("end_page")) & (needle != ""))
    exact, inside = F.col("text").contains(F.col("value")), F.col("norm").contains(needle)
    found = hits.where(exact | inside).groupBy("doc_id", "field").agg(
        F.min_by(F.struct("page_index", F.when(exact, 1.0).otherwise(0.9).alias("confidence"), F.when(exact, "exact_match").otherwise("normalized_contains").alias("method")), "page_index").alias("a")
    )
    return fields.join(found, ["doc_id", "field"], "left").select("doc_id", "field", "value", "start_page", "end_page", "a.page_index", "a.confidence", "a.method")


def attributed_grade(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """The earliest page of the range that says the grade: `grade N`, or a kindergarten form that is not K-12."""
    p = pages.select("doc_id", "page_index", X.norm_match(F.col("text")).alias("norm"))
    kinder = F.lower(F.trim("value")).isin("k", "kindergarten", "kinder")
    digits = F.nullif(F.regexp_extract("value", r"\b(\d{1,2})\b", 1), F.lit(""))
    hit = F.coalesce(F.regexp_like("norm", F.concat(F.lit(r"\b(?:grade|grado) *"), digits, F.lit(r"\b"))), F.lit(False)) | (
        kinder & (F.col("norm").rlike(r"\b(?:grade|grado) *(?:k|kindergarten|kinder)\b") | F.regexp_replace("norm", r"\b(?:kindergarten|kinder) *12\b", "").rlike(r"\b(?:kindergarten|kinder)\b"))
    )
    rows = fields.join(p, "doc_id").where(F.col("page_index").between(F.col("start_page"), F.col("end_page")) & hit)
    found = rows.groupBy("doc_id", "field").agg(F.min("page_index").alias("page_index"))
    return fields.join(found, ["doc_id", "field"], "left").withColumn("confidence", F.when(F.col("page_index").isNotNull(), 0.9))


def attribution_record(values: DataFrame) -> DataFrame:
    """One row per document with page and confidence of each field."""
    return values.groupBy("doc_id").pivot("field", ["student_name", "school_name"]).agg(F.first("page_index").alias("page"), F.first("confidence").alias("confidence"))


def attribution_expected(values: DataFrame) -> DataFrame:
    """Fields without a page and fields found elsewhere than on the first page of their range."""
    return values.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("page_index").isNull(), F.col("field")))), ",").alias("missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("page_index") != F.col("start_page"), F.col("field")))), ",").alias("elsewhere"),
    )


def attribution_rates(values: DataFrame, types: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Shares of values found in their chunk and on its first page by document type, and whether they reach the thresholds."""
    rates = values.join(types, "doc_id").groupBy("doc_type").agg(
        F.count("*").alias("total"),
        F.avg(F.col("page_index").isNotNull().cast("int")).alias("within_rate"),
        F.avg(F.coalesce(F.col("page_index") == F.col("start_page"), F.lit(False)).cast("int")).alias("start_rate"),
    )
    ok = (F.col("least_within").isNull() | (F.col("within_rate") >= F.col("least_within"))) & (F.col("least_start").isNull() | (F.col("start_rate") >= F.col("least_start")))
    return rates.join(thresholds, "doc_type", "left").withColumn("ok", ok).drop("least_within", "least_start")


def _described(s, d):
    return described(T.pages(s, d))


def _starts(s, d):
    return start_pages(_described(s, d))


def _fields(s, d):
    docs = T.pages(s, d).groupBy("doc_id").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"), F.max_by("text", "page_index").alias("late"), F.min_by("text", "page_index").alias("early"))
    name = F.when(F.col("doc_id") % 4 == 0, F.upper(F.substring(F.regexp_extract("late", r"([A-Za-z]+ [A-Za-z]+)", 1), 1, 40))).when(F.col("doc_id") % 4 == 1, F.lit("nobody at all")).otherwise(F.regexp_extract("early", r"([A-Za-z]+ [A-Za-z]+)", 1))
    school = F.when(F.col("doc_id") % 3 == 0, F.lit("--")).otherwise(F.lit("School Essay"))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("lo") + 1).otherwise(F.col("lo")).alias("start_page"), F.col("hi").alias("end_page"), F.explode(F.array(F.struct(F.lit("student_name").alias("field"), name.alias("value")), F.struct(F.lit("school_name").alias("field"), school.alias("value")))).alias("f"))
    return rows.select("doc_id", "f.field", "f.value", "start_page", "end_page")


def _grade_pages(s, d):
    say = F.when(F.col("page_index") % 3 == 0, F.concat(F.lit("Grade: "), (F.col("doc_id") % 14).cast("string"), F.lit("\n"))).when(F.col("page_index") % 3 == 1, F.lit("a K-12, kinder-12 school; Kindergarten?\n")).otherwise(F.lit(""))
    return T.pages(s, d).withColumn("text", F.concat(say, "text"))


def _grades(s, d):
    docs = T.pages(s, d).groupBy("doc_id").agg(F.min("page_index").alias("start_page"), F.max("page_index").alias("end_page"))
    value = F.when(F.col("doc_id") % 6 == 0, "K").when(F.col("doc_id") % 6 == 1, "none").otherwise((F.col("doc_id") % 14).cast("string"))
    return docs.select("doc_id", F.lit("grade").alias("field"), value.alias("value"), "start_page", "end_page")


def _thresholds(s):
    return s.createDataFrame([("ifi_typed_form_submission", 0.95, 0.95), ("bulk_scanned_batch", 0.75, None)], "doc_type string, least_within double, least_start double")


def _types(s, d):
    return T.pages(s, d).select("doc_id").distinct().withColumn("doc_type", T.pick(T.DOC_TYPES, F.col("doc_id") % 9))


def _banded(s, d):
    """Starts with dark bands that follow from the texts; in every second document all pages have the form's header."""
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("Student Name Grade School Essay\n")).otherwise(F.lit(""))
    low = (F.length("text") % 20) / 20.0
    bands = F.when(F.length("text") % 3 != 0, F.array(F.struct(low.alias("y0"), (low + 0.05).alias("y1"))))
    rows = start_pages(described(T.pages(s, d).withColumn("text", F.concat(head, F.col("text")))))
    return rows.withColumn("bands", bands)


def _lists(s, d):
    page = lambda i: F.struct(F.lit(i).alias("page_index"), F.concat(F.lit("t"), F.lit(i)).alias("text"))
    none = F.array().cast("array<struct<page_index:string,text:string>>")
    return T.read(s, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.array(page("2"), page("x"))).otherwise(none).alias("summary"),
        F.when(F.col("doc_id") % 3 == 0, F.array(page("0"))).alias("ocr_pages"),
        F.array(page("7"), page("8")).alias("pages"),
    )


def _values(s, d):
    return attributed(_fields(s, d), T.pages(s, d))


QUERIES = {
    "doc_format": lambda s, d: doc_format(_described(s, d)),
    "start_pages": lambda s, d: _starts(s, d).select("doc_id", "page_index", "is_start"),
    "periodic_starts": lambda s, d: periodic_starts(_starts(s, d)).select("doc_id", "page_index", "is_start"),
    "band_refine": lambda s, d: band_refine(_banded(s, d)).select("doc_id", "page_index", "is_start"),
    "chunk_ranges": lambda s, d: chunk_ranges(_starts(s, d)),
    "doc_structure": lambda s, d: doc_structure(_starts(s, d)),
    "bulk_heuristic": lambda s, d: bulk_heuristic(_starts(s, d)),
    "alternating_pages": lambda s, d: alternating_pages(_starts(s, d)),
    "range_plan": lambda s, d: range_plan(_starts(s, d)),
    "header_peaks": lambda s, d: header_peaks(_described(s, d)),
    "page_coverage": lambda s, d: page_coverage(T.pages(s, d), chunk_ranges(_starts(s, d)).withColumn("start_page", F.col("start_page") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).where("start_page <= end_page")),
    "conf_stats": lambda s, d: conf_stats(_described(s, d)),
    "assemble_text": lambda s, d: assemble_text(T.pages(s, d).withColumn("text", F.when((F.col("doc_id") % 6 == 0) & (F.col("page_index") % 2 == 1), F.lit("  ")).otherwise(F.col("text")))),
    "page_source": lambda s, d: page_source(_lists(s, d)),
    "attr_value": lambda s, d: _values(s, d).drop("start_page", "end_page"),
    "attr_grade": lambda s, d: attributed_grade(_grades(s, d), _grade_pages(s, d)).select("doc_id", "value", "page_index", "confidence"),
    "attr_record": lambda s, d: attribution_record(_values(s, d)),
    "attr_expected": lambda s, d: attribution_expected(_values(s, d)),
    "attr_rates": lambda s, d: attribution_rates(_values(s, d), _types(s, d), _thresholds(s)),
}


def _score(words):
    return "least(1.0, (" + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + ") / 13.0::double)"


DESCRIBED = f"""
dp as (select *, {_score(X.HEADER_WORDS)} as score, {_score(X.RELAXED_WORDS)} as relaxed, length(text) as chars, length(text) >= 200 as has_text, length(text) % 100 / 100.0::double as confidence,
  min(page_index) over (partition by doc_id) as lo from doc_pages),
df as (select doc_id, case when bool_and(has_text) then 'native_text' when not bool_or(has_text) then 'image_only' else 'hybrid' end as format, count(*)::bigint as pages from dp group by 1),
st as (select dp.*, format, pages, (case when format <> 'native_text' then relaxed >= 0.15 and chars >= 5 else score >= 0.2 and chars >= 10 end) or page_index = lo as is_start from dp join df using (doc_id)),
cr as (select doc_id, (row_number() over (partition by doc_id order by page_index) - 1)::int as chunk_index, page_index as start_page, coalesce(lead(page_index) over (partition by doc_id order by page_index) - 1, hi) as end_page
  from (select * from (select *, max(page_index) over (partition by doc_id) as hi from st) where is_start)),
alt as (select doc_id, count(*) as n, coalesce(count(*) >= 4 and count(*) % 2 = 0 and avg(relaxed) filter ((page_index - lo) % 2 = 0) > 0
  and avg(relaxed) filter ((page_index - lo) % 2 = 1) < avg(relaxed) filter ((page_index - lo) % 2 = 0) * 1.15, false) as alternating from st group by 1)
"""
_N = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
FIELDS = f"""
dd as (select doc_id, min(page_index) as lo, max(page_index) as hi, arg_max(text, page_index) as late, arg_min(text, page_index) as early from doc_pages group by 1),
fl as (select doc_id, 'student_name' as field, case when doc_id % 4 = 0 then upper(substr(regexp_extract(late, '([A-Za-z]+ [A-Za-z]+)', 1), 1, 40)) when doc_id % 4 = 1 then 'nobody at all' else regexp_extract(early, '([A-Za-z]+ [A-Za-z]+)', 1) end as value,
    case when doc_id % 5 = 0 then lo + 1 else lo end as start_page, hi as end_page from dd
  union all select doc_id, 'school_name', case when doc_id % 3 = 0 then '--' else 'School Essay' end, case when doc_id % 5 = 0 then lo + 1 else lo end, hi from dd),
ht as (select f.doc_id, f.field, page_index, contains(text, value) as exact, row_number() over (partition by f.doc_id, f.field order by page_index) as nth from fl f join doc_pages p on p.doc_id = f.doc_id
  and page_index between start_page and end_page and {_N.format('value')} <> '' and (contains(text, value) or contains({_N.format('text')}, {_N.format('value')}))),
av as (select f.*, h.page_index, case when exact then 1.0::double when not exact then 0.9::double end as confidence, case when exact then 'exact_match' when not exact then 'normalized_contains' end as method
  from fl f left join ht h on h.doc_id = f.doc_id and h.field = f.field and nth = 1)
"""
_D, _F = (T.PAGES, DESCRIBED), (T.PAGES, FIELDS)
_BANDED = (
    T.PAGES.replace("doc_pages as", "own_pages as"),
    "doc_pages as (select * exclude text, case when doc_id % 2 = 0 then 'Student Name Grade School Essay' || chr(10) else '' end || text as text from own_pages)",
)
ORACLE = {
    "doc_format": T.sql("select * from df", *_D),
    "start_pages": T.sql("select doc_id, page_index, is_start from st", *_D),
    "periodic_starts": T.sql("""c as (select *, (page_index - lo) % 2 = 0 and (page_index = lo or (relaxed >= 0.1 and chars >= 3)) as cand from st),
      k as (select *, count(*) filter (is_start) over (partition by doc_id) as n, count(*) filter (cand) over (partition by doc_id) as kk from c)
      select doc_id, page_index, case when format <> 'native_text' and pages >= 6 and n = 1 and kk >= 2 then cand else is_start end as is_start from k""", *_D),
    "band_refine": T.sql("""b as (select *, coalesce(length(text) % 3 <> 0 and length(text) % 20 / 20.0 < 0.15, false) as dark from st),
      k as (select *, bool_and(is_start) over w and pages >= 4 and format <> 'native_text' and not bool_and(confidence < 0.35) over w as every, count(*) filter (dark) over w as n from b window w as (partition by doc_id))
      select doc_id, page_index, case when every and n >= 2 then page_index = lo or dark else is_start end as is_start from k""", *_BANDED, DESCRIBED),
    "chunk_ranges": T.sql("select * from cr", *_D),
    "doc_structure": T.sql("select doc_id, case when bool_and(format <> 'native_text' and confidence < 0.35) then 'single' when bool_and(regexp_matches(text, '(?i)^student name grade school essay') and chars < 150) then 'template' when count(*) filter (is_start) > 1 then 'multi' else 'single' end as structure from st group by 1", *_D),
    "bulk_heuristic": T.sql("select doc_id, count(*) > 1 and count(*) filter (contains(lower(text), 'student name')) >= 2 and count(*) filter (page_index - lo < 3 and score >= 0.2) >= 2 as bulk from st group by 1", *_D),
    "alternating_pages": T.sql("select doc_id, alternating from alt", *_D),
    "range_plan": T.sql("select doc_id, unnest(range(0, n, case when alternating then 2 else 1 end)) as start_page, unnest(range(0, n, case when alternating then 2 else 1 end)) + case when alternating then 1 else 0 end as end_page from alt", *_D),
    "header_peaks": T.sql("p as (select doc_id, score >= 0.2 and score > coalesce(lag(score) over w, -1) and score >= coalesce(lead(score) over w, -1) as peak from dp window w as (partition by doc_id order by page_index)) select doc_id, count(*) filter (peak) >= 2 as several_peaks from p group by 1", *_D),
    "page_coverage": T.sql("""r as (select doc_id, start_page + case when doc_id % 4 = 0 then 1 else 0 end as s, end_page as e from cr), h as (select doc_id, unnest(range(s, e + 1)) as page_index from r where s <= e), t as (select doc_id, page_index, count(*)::bigint as times from h group by 1, 2)
      select doc_id, page_index, coalesce(times, 0) as times from doc_pages full join t using (doc_id, page_index) where times is null or times <> 1""", *_D),
    "conf_stats": T.sql("r as (select *, row_number() over (partition by doc_id order by confidence) as r, count(*) over (partition by doc_id) as n from dp) select doc_id, min(confidence) as least, max(case when r = greatest(n // 10, 1) then confidence end) as p10, count(*) filter (confidence < 0.65)::bigint as low_pages from r group by 1", *_D),
    "assemble_text": T.sql("t as (select doc_id, page_index, case when doc_id % 6 = 0 and page_index % 2 = 1 then '  ' else text end as text from doc_pages) select doc_id, case when count(*) > 1 and bool_or(trim(text) = '') then null else string_agg(text, chr(10) || chr(10) order by page_index) end as text from t group by 1", T.PAGES),
    "page_source": "select doc_id, page_index, 't' || page_index as text from (select doc_id, case when doc_id % 2 = 0 then 2 when doc_id % 3 = 0 then 0 else 7 end::int as page_index from documents union all select doc_id, 8 from documents where doc_id % 2 <> 0 and doc_id % 3 <> 0)",
    "attr_value": T.sql("select doc_id, field, value, page_index, confidence, method from av", *_F),
    "attr_grade": T.sql(rf"""g as (select doc_id, case when doc_id % 6 = 0 then 'K' when doc_id % 6 = 1 then 'none' else (doc_id % 14)::varchar end as value from (select distinct doc_id from doc_pages)),
      p as (select doc_id, page_index, {_N.format("case when page_index % 3 = 0 then 'Grade: ' || (doc_id % 14) || chr(10) when page_index % 3 = 1 then 'a K-12, kinder-12 school; Kindergarten?' || chr(10) else '' end || text")} as norm from doc_pages),
      h as (select g.doc_id, min(page_index) as page_index from g join p using (doc_id) where (doc_id % 6 > 1 and regexp_matches(norm, '\b(?:grade|grado) *' || value || '\b'))
        or (doc_id % 6 = 0 and (regexp_matches(norm, '\b(?:grade|grado) *(?:k|kindergarten|kinder)\b') or regexp_matches(regexp_replace(norm, '\b(?:kindergarten|kinder) *12\b', '', 'g'), '\b(?:kindergarten|kinder)\b'))) group by 1)
      select g.doc_id, value, page_index, case when page_index is not null then 0.9::double end as confidence from g left join h using (doc_id)""", T.PAGES),
    "attr_record": T.sql("select doc_id, max(page_index) filter (field = 'student_name') as student_name_page, max(confidence) filter (field = 'student_name') as student_name_confidence, max(page_index) filter (field = 'school_name') as school_name_page, max(confidence) filter (field = 'school_name') as school_name_confidence from av group by 1", *_F),
    "attr_expected": T.sql("select doc_id, coalesce(string_agg(field, ',' order by field) filter (page_index is null), '') as missing, coalesce(string_agg(field, ',' order by field) filter (page_index <> start_page), '') as elsewhere from av group by 1", *_F),
    "attr_rates": T.sql(f"""r as (select ({list(T.DOC_TYPES)})[doc_id % 9 + 1] as doc_type, count(*)::bigint as total, avg((page_index is not null)::int) as within_rate, avg(coalesce(page_index = start_page, false)::int) as start_rate from av group by 1)
      select *, case doc_type when 'ifi_typed_form_submission' then within_rate >= 0.95 and start_rate >= 0.95 when 'bulk_scanned_batch' then within_rate >= 0.75 else true end as ok from r""", *_F),
}
