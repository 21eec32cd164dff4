"""Queries of the text functions over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.functions import fixed as V
from leafmark.functions import plausible as P
from leafmark.functions import text as X
from leafmark.plans import tables as T

RAW_GRADES = (
    "5", "Grade 7", "10th", "K", "Kindergarten", "pre-k", "13", "0", "2022", "grade: 3", "8th grade", "third", "", "-4", "Grado 6", "99", "12", "unknown", " 4 ", "5TH",
    "K-12", "Rinder", "it is my 5 favorite days", "Grade: 12th", "PREK", "kinder.", "Segundo grado",
)
RAW_NAMES = (
    "  st. mary's  hs ", "PS 12", "de la salle", "--x--", "Ålesund School!", "the essay is long and has many words", "ANN lee", "ann lee", "my dog was here", "O'Neil Straße",
    "", "7 8 9", "Page 3", "Éva Müller", "K school", "north   ridge\telementary",
)


GRADE_TEXT = r"((?:[A-Za-z]+ )?[0-9]{1,4}(?:st|nd|rd|th)?(?: [A-Za-z]+)?)"
NAME_TEXT = r"([A-Z][A-Za-z]+(?: [A-Za-z0-9]+){0,5})"


def _raw(values, pattern):
    """Awkward values for every third document, what its text says for the others."""

    def relation(s, d):
        i, n = F.col("doc_id"), len(values) + 1
        raw = F.when(i % 3 == 0, T.pick(values, F.floor(i / 3) % n)).otherwise(F.regexp_extract("text", pattern, 1))
        return T.read(s, d, "documents").select("doc_id", raw.alias("raw"))

    return relation


grades, names = _raw(RAW_GRADES, GRADE_TEXT), _raw(RAW_NAMES, NAME_TEXT)


def _files(s, d):
    made = F.concat(F.lit("in/"), F.replace("raw", F.lit(" "), F.lit("_")), F.when(F.col("doc_id") % 2 == 0, "-essay.pdf").otherwise("-2026-Fatherhood-Contest (2).pdf"))
    return names(s, d).select("doc_id", P.name_from_file(made).alias("name"))


def _schools(s, d):
    """School names of records, and known spellings in other shapes."""
    i, known = F.col("doc_id"), tuple(V.SCHOOL_KEYS) + tuple(V.SCHOOL_TYPOS)
    spelled = T.pick(known, F.floor(i / 2) % len(known))
    raw = F.when(i % 2 == 0, F.when(i % 4 == 0, F.upper(spelled)).otherwise(F.concat(F.lit(" ."), F.initcap(spelled), F.lit("! ")))).otherwise(F.col("school_name"))
    shown, key = P.canon_name(raw)
    return T.submissions(s, d).select("doc_id", raw.alias("raw"), shown.alias("shown"), key.alias("key"))


def _values(name, values, pattern):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"{name} as (select doc_id, case when doc_id % 3 = 0 then ([{quoted}])[doc_id // 3 % {len(values) + 1} + 1] else regexp_extract(text, '{pattern}', 1) end as raw from documents)"


def _pair(f, c="raw", names=("grade", "method")):
    def query(s, d):
        a, b = f(F.col(c))
        return grades(s, d).select("doc_id", "raw", a.alias(names[0]), b.alias(names[1]))

    return query


def _one(relation, f, name):
    return lambda s, d: relation(s, d).select("doc_id", "raw", f(F.col("raw")).alias(name))


def _docs(**columns):
    return lambda s, d: T.read(s, d, "documents").select("doc_id", *[f(F.col("text")).alias(k) for k, f in columns.items()])


def _subs(**columns):
    return lambda s, d: T.submissions(s, d).select("doc_id", *[(f() if callable(f) else f).alias(k) for k, f in columns.items()])


def _structure():
    return F.when(F.col("doc_id") % 7 == 0, "multi").when(F.col("doc_id") % 7 == 1, "template").otherwise("single")


def _layout():
    return F.when(F.col("doc_id") % 8 == 0, "ifi_official_scanned").when(F.col("doc_id") % 8 == 1, "ifi_official_typed")


def _email_list():
    i = F.col("doc_id").cast("string")
    return F.concat(F.lit("A"), i, F.lit("@x.org, bad"), i, F.lit("\na"), i, F.lit("@x.org,, c@y.de"))


def _emails(s, d):
    good, bad = X.emails(_email_list())
    return T.read(s, d, "documents").select("doc_id", F.array_join(good, ";").alias("valid"), F.array_join(bad, ";").alias("invalid"))


def _loose():
    return F.concat(F.lower("review_reason_codes"), F.lit("; , missing_grade,[];empty_essay"))


#: For each letter, what stands for it in texts with marks of their own and with letters that decompose.
MARKED = {"e": "e\u0301\u0323\u1ec6", "o": "\u01ea\u0304", "a": "a\u0308"}


def _marked(c):
    for letter, marks in MARKED.items():
        c = F.replace(c, F.lit(letter), F.lit(marks))
    return c


def _sql_marked(c: str) -> str:
    for letter, marks in MARKED.items():
        c = f"replace({c}, '{letter}', '{marks}')"
    return c


QUERIES = {
    "norm_key": _one(names, X.norm_key, "key"),
    "norm_match": _one(names, X.norm_match, "key"),
    "norm_accent": _docs(plain=lambda c: X.norm_accent(F.substring(c, 1, 1 << 30))),
    "norm_accent_marks": _docs(plain=lambda c: X.norm_accent(_marked(c))),
    "display_name": _one(names, X.display_name, "shown"),
    "grade_policy": _pair(X.grade_policy),
    "grade_pipeline": _pair(X.grade_pipeline, names=("grade", "reason")),
    "grade_gate": _one(grades, X.grade_gate, "grade"),
    "grade_parse": _one(grades, X.grade_parse, "grade"),
    "grade_extract": _one(grades, X.grade_extract, "grade"),
    "grade_admin": lambda s, d: grades(s, d).select("doc_id", "raw", X.grade_admin(F.col("raw")).alias("admin"), X.grade_bulk(F.col("raw")).alias("bulk")),
    "grade_words": _one(grades, X.grade_words, "grade"),
    "text_metrics": _docs(
        words=lambda c: F.size(X.words(c)).cast("long"),
        chars=lambda c: F.length(c).cast("long"),
        paragraphs=lambda c: F.size(F.filter(F.split(c, "\n\n"), lambda p: p.rlike(r"[^\x09-\x0D\x20]"))).cast("long"),
    ),
    "quality_score": _docs(score=X.quality_score),
    "header_score": lambda s, d: T.pages(s, d).select("doc_id", "page_index", X.header_score(F.col("text")).alias("score"), X.header_score(F.col("text"), True).alias("relaxed")),
    "suspicious_name": _one(names, X.suspicious_name, "suspicious"),
    "route_doc_type": _subs(
        routed=lambda: X.route_doc_type(F.col("doc_id") % 20 == 0, _structure(), F.col("format"), _layout(), F.col("ocr_confidence_avg"), F.col("doc_id") % 3 == 2, F.col("filename"))
    ),
    "doc_class": _subs(cls=lambda: X.doc_class(F.col("format"), _structure(), F.col("doc_id") % 3 + 1, F.col("doc_id") % 2 + 1)),
    "doc_role": _subs(role=lambda: X.doc_role(F.col("is_chunk"), F.col("is_container_parent"), _structure(), F.col("doc_class"))),
    "doc_type_map": _subs(mapped=lambda: X.doc_type_map(F.when(F.col("doc_id") % 3 == 0, F.upper("doc_type")).when(F.col("doc_id") % 3 == 1, F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, F.col("doc_type")), F.col("doc_id") % 5 == 0)),
    "codes_norm": lambda s, d: T.submissions(s, d).select(
        "doc_id",
        F.array_join(X.codes_norm(F.col("review_reason_codes")), ";").alias("plain"),
        F.array_join(X.codes_norm(F.col("review_reason_codes"), enum_only=True), ";").alias("known"),
        F.array_join(X.codes_norm(_loose(), loose=True), ";").alias("loose"),
    ),
    "codes_label": _subs(label=lambda: X.codes_label(X.codes_norm(F.col("review_reason_codes"), enum_only=True))),
    "pii_hash": _subs(student=lambda: X.pii_hash(F.col("student_name"), "pepper"), school=lambda: X.pii_hash(F.col("school_name"), "pepper")),
    "conf_bucket": _subs(bucket=lambda: X.conf_bucket(F.when(F.col("doc_id") % 9 != 0, F.col("ocr_confidence_avg")))),
    "name_from_file": _files,
    "canon_name": _schools,
    "email_parse": _emails,
    "snippet": _docs(snippet=lambda c: X.snippet(c)),
    "date_display": _subs(shown=lambda: F.date_format("created_at", "MMM dd, yyyy")),
}

W = r"[\x09-\x0D\x20]"
TRIM = rf"regexp_replace(raw, '^{W}+|{W}+$', '', 'g')"
_PIPE = r"""coalesce({}, {}, {})""".format(
    *[
        f"(select v from (select try_cast(nullif(regexp_extract(text, '{p}', 1), '') as bigint) as v) where v between 1 and 12)"
        for p in (r"(?i)grade[:\x09-\x0D\x20]*([0-9]{1,2})", r"(?i)([0-9]{1,2})(?:st|nd|rd|th)?[\x09-\x0D\x20]*grade", r"^([0-9]{1,2})$")
    ]
)
_GRADES, _NAMES = _values("g", RAW_GRADES, GRADE_TEXT), _values("n", RAW_NAMES, NAME_TEXT)
_CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_STRUCT = "case when doc_id % 7 = 0 then 'multi' when doc_id % 7 = 1 then 'template' else 'single' end"
_OUTER = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~\x09-\x0D\x20]+"""
ORACLE = {
    "norm_key": T.sql(rf"select doc_id, raw, replace(lower(regexp_replace(regexp_replace(coalesce(raw, ''), '^{W}+|{W}+$', '', 'g'), '{W}+', ' ', 'g')), 'ß', 'ss') as key from n", _NAMES),
    "norm_match": T.sql("select doc_id, raw, trim(regexp_replace(replace(lower(coalesce(raw, '')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) as key from n", _NAMES),
    "norm_accent_marks": f"""select doc_id, translate(strip_accents(lower({_sql_marked("text")})), '’‘“”', '\'\'\'\'""') as plain from documents""",
    "norm_accent": "select doc_id, translate(lower(text), '{}', '{}') as plain from documents".format(X.ACCENTS_FROM, X.ACCENTS_TO.replace("'", "''")),
    "display_name": T.sql(rf"""t as (select doc_id, raw, array_to_string(list_filter(regexp_split_to_array(regexp_replace({TRIM}, '^{_OUTER}|{_OUTER}$', '', 'g'), '{W}+'), lambda x: x <> ''), ' ') as s from n)
      select doc_id, raw, case when length(s) >= 3 then array_to_string(list_transform(string_split(s, ' '), lambda w: case when upper(w) in ({_in(X.ACRONYMS)}) then upper(w) else {_CAP.format('w')} end), ' ') end as shown from t""", _NAMES),
    "grade_policy": T.sql(rf"""t as (select doc_id, raw, lower({TRIM}) as low from g), v as (select *, try_cast(nullif(regexp_extract(low, '(-?\d+)', 1), '') as bigint) as v from t)
      select doc_id, raw, case when low in ({_in(X.KINDER_POLICY)}) then 'K' when v between 1 and 12 then v::varchar end as grade,
        case when raw is null or low = '' then 'missing' when low in ({_in(X.KINDER_POLICY)}) then 'kindergarten_alias' when v is null then 'unparseable'
          when v not between 1 and 12 then 'invalid_range' when low = v::varchar then 'numeric' when contains(low, 'grade') then 'grade_prefix'
          when regexp_matches(low, '\d+(st|nd|rd|th)\b') then 'ordinal' else 'numeric_parse' end as method from v""", _GRADES),
    "grade_pipeline": T.sql(rf"""t as (select doc_id, raw, {TRIM} as text from g), v as (select *, {_PIPE} as v, lower(text) in ({_in(X.KINDER_PIPELINE)}) as kinder from t)
      select doc_id, raw, case when not kinder then v end as grade, case when raw is null then 'missing' when text = '' then 'empty' when kinder then 'kinder' when v is not null then 'parsed' else 'unparsed' end as reason from v""", _GRADES),
    "grade_gate": T.sql(rf"""t as (select doc_id, raw, upper({TRIM}) as s from g)
      select doc_id, raw, case when lower(s) in ({_in(X.KINDER_PIPELINE)}) then 'K' when regexp_full_match(s, '[+-]?\d{{1,9}}') and s::bigint between 1 and 12 then (s::bigint)::varchar end as grade from t""", _GRADES),
    "grade_parse": T.sql(f"select doc_id, raw, {P.sql_grade('raw')} as grade from g", _GRADES),
    "grade_extract": T.sql(rf"""t as (select doc_id, raw, upper({TRIM}) as s from g), v as (select *, regexp_extract(s, '(\d+)', 1) as x from t)
      select doc_id, raw, case when s in ('K', 'KINDER', 'KINDERGARTEN') then 'K' when length(x) between 1 and 3 and x::bigint between 1 and 12 then (x::bigint)::varchar end as grade from v""", _GRADES),
    "grade_admin": T.sql(rf"""t as (select doc_id, raw, {TRIM} as s from g), v as (select *, try_cast(nullif(regexp_extract(s, '(\d+)', 1), '') as bigint) as v from t)
      select doc_id, raw, case when coalesce(s, '') = '' then null when upper(s) in ('K', 'KINDER', 'KINDERGARTEN') then 'K' when upper(s) in ('PRE-K', 'PREK', 'PRE-KINDERGARTEN') then 'Pre-K' when v between 1 and 12 then v::varchar else s end as admin,
        case when coalesce(raw, '') = '' then null when upper(raw) in ('K', 'KINDER', 'KINDERGARTEN', 'PRE-K', 'PREK', 'PRE-KINDERGARTEN') then 'K' when v between 1 and 12 then v::varchar else raw end as bulk from v""", _GRADES),
    "grade_words": T.sql(rf"""t as (select doc_id, raw, lower({TRIM}) as low from g), v as (select *, coalesce(try_cast(nullif(regexp_extract(low, '\b(\d{{1,2}})(?:st|nd|rd|th)\b', 1), '') as bigint),
        case {" ".join(f"when contains(low, '{w}') then {n}" for w, n in X.ORDINALS.items())} end, try_cast(nullif(regexp_extract(low, '\b(\d{{1,2}})\b', 1), '') as bigint)) as v from t)
      select doc_id, raw, case when v between 1 and 12 then v end as grade from v""", _GRADES),
    "text_metrics": rf"select doc_id, len(regexp_extract_all(text, '[^\x09-\x0D\x20]+'))::bigint as words, length(text)::bigint as chars, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\x09-\x0D\x20]')))::bigint as paragraphs from documents",
    "quality_score": rf"""select doc_id, case when s = 0 then 0 else greatest(0, least(1, l / s::double * 0.8 + (1 - (s - a) / s::double) * 0.2)) end as score from (select doc_id,
      length(regexp_replace(text, '{W}+', '', 'g')) as s, length(regexp_replace(text, '[^\pL]+', '', 'g')) as l, length(regexp_replace(text, '[^\pL\pN]+', '', 'g')) as a from documents)""",
    "header_score": T.sql("select doc_id, page_index, least(1.0, ({}) / 13.0::double) as score, least(1.0, ({}) / 13.0::double) as relaxed from doc_pages".format(*[" + ".join(f"contains(lower(text), '{w}')::int" for w in ws) for ws in (X.HEADER_WORDS, X.RELAXED_WORDS)]), T.PAGES),
    "suspicious_name": T.sql(rf"""t as (select doc_id, raw, list_filter(regexp_split_to_array(coalesce(raw, ''), '{W}+'), lambda x: x <> '') as w from n), u as (select *, list_filter(w, lambda x: regexp_matches(x, '\pL')) as l from t)
      select doc_id, raw, len(w) > 5 or len(list_filter(w, lambda x: lower(regexp_replace(x, '^[.,!?]+|[.,!?]+$', '', 'g')) in ({_in(X.VERBS)}))) > 0
        or coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / nullif(len(l), 0)::double < 0.4, false) as suspicious from u""", _NAMES),
    "route_doc_type": T.sql(f"""t as (select *, {_STRUCT} as structure, case when doc_id % 8 = 0 then 'ifi_official_scanned' when doc_id % 8 = 1 then 'ifi_official_typed' else '' end as layout, format in ('image_only', 'hybrid') as scanned from submissions)
      select doc_id, case when doc_id % 20 = 0 then 'ifi_typed_form_submission' when structure = 'template' then 'template' when structure = 'multi' and scanned then 'bulk_scanned_batch'
        when layout = 'ifi_official_scanned' or (scanned and ocr_confidence_avg >= 0.2) then 'ifi_official_form_scanned' when layout = 'ifi_official_typed' then 'ifi_official_form_filled'
        when format = 'native_text' and doc_id % 3 <> 2 then 'standard_freeform_essay' else 'unknown' end as routed from t""", T.SUBMISSIONS),
    "doc_class": T.sql(f"""t as (select *, {_STRUCT} as structure from submissions) select doc_id, case when structure = 'multi' and doc_id % 2 + 1 > 1 then 'BULK_SCANNED_BATCH' when structure = 'single' and doc_id % 3 + 1 > 1 then 'MULTI_PAGE_SINGLE'
      when format = 'native_text' then 'SINGLE_TYPED' else 'SINGLE_SCANNED' end as cls from t""", T.SUBMISSIONS),
    "doc_role": T.sql(f"select doc_id, case when is_chunk then 'document' when is_container_parent or {_STRUCT} = 'multi' or doc_class = 'BULK_SCANNED_BATCH' then 'container' else 'document' end as role from submissions", T.SUBMISSIONS),
    "doc_type_map": T.sql(f"""t as (select doc_id, coalesce(case when doc_id % 3 = 0 then lower(doc_type) end, case when doc_id % 2 = 0 then doc_type end) as x from submissions)
      select doc_id, case when x is null and doc_id % 5 = 0 then 'template' when x is null then 'unknown' when x = 'essay_only' then 'standard_freeform_essay' when x in ({_in(X.POLICY_TYPES)}) then x else 'unknown' end as mapped from t""", T.SUBMISSIONS),
    "codes_norm": T.sql(rf"""t as (select doc_id, list_sort(list_distinct(list_filter(string_split(review_reason_codes, ';'), lambda x: x <> ''))) as c,
        list_sort(list_distinct(list_filter(list_transform(string_split(replace(upper(review_reason_codes || '; , missing_grade,[];empty_essay'), ',', ';'), ';'), lambda x: trim(x)), lambda x: x not in ('', '[]', '{{}}', 'NULL')))) as l from submissions)
      select doc_id, array_to_string(c, ';') as plain, array_to_string(list_filter(c, lambda x: x in ({_in(X.ENUM)})), ';') as known, array_to_string(l, ';') as loose from t""", T.SUBMISSIONS),
    "codes_label": T.sql(rf"""t as (select doc_id, list_sort(list_distinct(list_filter(string_split(review_reason_codes, ';'), lambda x: x in ({_in(X.ENUM)})))) as c from submissions)
      select doc_id, array_to_string(list_transform(c, lambda x: substr(x, 1, 1) || lower(replace(substr(x, 2), '_', ' '))), ' • ') as label from t""", T.SUBMISSIONS),
    "pii_hash": T.sql("select doc_id, case when trim(student_name) <> '' then sha256('pepper:' || trim(student_name)) end as student, case when trim(school_name) <> '' then sha256('pepper:' || trim(school_name)) end as school from submissions", T.SUBMISSIONS),
    "conf_bucket": T.sql("select doc_id, case when doc_id % 9 = 0 then 'unknown' when ocr_confidence_avg < 0.5 then 'low' when ocr_confidence_avg < 0.75 then 'medium' else 'high' end as bucket from submissions", T.SUBMISSIONS),
    "name_from_file": T.sql("t as (select doc_id, 'in/' || replace(raw, ' ', '_') || case when doc_id % 2 = 0 then '-essay.pdf' else '-2026-Fatherhood-Contest (2).pdf' end as f from n) select doc_id, {} as name from t".format(P.sql_name_from_file("f")), _NAMES),
    "canon_name": T.sql(rf"""k as (select doc_id, school_name, ([{", ".join(P.quote(v) for v in (*V.SCHOOL_KEYS, *V.SCHOOL_TYPOS))}])[doc_id // 2 % {len(V.SCHOOL_KEYS) + len(V.SCHOOL_TYPOS)} + 1] as sp from submissions),
      r as (select doc_id, case when doc_id % 4 = 0 then upper(sp) when doc_id % 2 = 0 then ' .' || array_to_string(list_transform(string_split(sp, ' '), lambda w: {_CAP.format('w')}), ' ') || '! ' else school_name end as raw from k),
      t as (select doc_id, raw, array_to_string(list_filter(regexp_split_to_array(regexp_replace({TRIM}, '^{_OUTER}|{_OUTER}$', '', 'g'), '{W}+'), lambda x: x <> ''), ' ') as s from r),
      u as (select doc_id, raw, case when length(s) >= 3 then array_to_string(list_filter(string_split(regexp_replace(lower(s), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), ' '), lambda x: x <> ''), ' ') end as p from t),
      v as (select doc_id, raw, coalesce({P.sql_map(V.SCHOOL_TYPOS, 'p')}, p) as p from u), w as (select *, {P.sql_map(V.SCHOOL_KEYS, 'p')} as key from v)
      select doc_id, raw, coalesce({P.sql_map(V.SCHOOL_NAMES, 'key')}, array_to_string(list_transform(string_split(p, ' '), lambda w: case when upper(w) in ({_in(X.ACRONYMS)}) then upper(w) else {_CAP.format('w')} end), ' ')) as shown, key from w""", T.SUBMISSIONS),
    "email_parse": "select doc_id, 'a' || doc_id || '@x.org;c@y.de' as valid, 'bad' || doc_id as invalid from documents",
    "snippet": "select doc_id, substr(array_to_string(string_split(text, chr(10))[1:20], chr(10)), 1, 300) as snippet from documents",
    "date_display": T.sql("select doc_id, strftime(created_at, '%b %d, %Y') as shown from submissions", T.SUBMISSIONS),
}
