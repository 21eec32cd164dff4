"""Whole forms: typed forms by zone, headers of free texts, grades by place, and the merge of all extractors.

One projection after another over a document's lines, without an exchange. A step that later ones need more than once is a column of
its own; extractors that only some documents need run only for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import fixed as V
from leafmark.functions import plausible as P
from leafmark.functions import signals as S
from leafmark.functions import text as X
from leafmark.functions.plausible import has_any
from leafmark.functions.text import let
from leafmark.operators import lines as L
from leafmark.plans import tables as T

HEADER_TYPES, EMPTY_TYPES = ("essay_with_header_metadata",), ("template", "essay_only")
ORDINALS = (r"(?i)\b([1-9]|1[0-2])(?:st|nd|rd|th)?[ ]*grade\b", r"(?i)(?:grade|grado)[ ]*[:\-/]?[ ]*([1-9]|1[0-2])\b", r"(?i)\b([1-9]|1[0-2])[ ]*(?:st|nd|rd|th)?[ ]*(?:grade|grado)")
KINDER = r"(?i)\b(?:k|kinder|kindergarten|pre[ -]?k)\b"
DIGITS = r"^0?([1-9]|1[0-2])$"
DATED = "(?:" + "|".join(V.WEEKDAYS) + ")"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))


def _ordinal(c: Column) -> Column:
    return F.coalesce(*[_found(c, p) for p in ORDINALS])


def grade_placement(doc_type: Column, lines: Column, contact: Column, contact_keys: Column) -> Column:
    """A grade by where it stands: none on blank forms and bare essays, in the header of free texts, by label and place on forms.

    lines are the worded lines of contact and text together.
    """
    head = F.array_join(F.slice(lines, 1, 6), "\n")
    kinder = lambda c: F.when(c.rlike(KINDER), "K")
    single = lambda some: L.first(F.transform(some, lambda x: _found(x, DIGITS)))
    below = L.first(F.transform(lines, lambda x, i: F.when(x.rlike("(?i)grade|grado") & ~x.rlike(r"\d"), F.coalesce(_found(F.get(lines, i + 1), DIGITS), _ordinal(F.get(lines, i + 1))))))
    labelled = F.coalesce(X.grade_parse(L.near_label(contact, contact_keys, V.ALIASES["grade"], 30, value_after_label_only=True)), L.near_anchor(contact, contact_keys))
    free = let(head, lambda h: F.coalesce(_ordinal(h), kinder(h), single(F.slice(lines, 1, 4))))
    return F.when(doc_type.isin(*EMPTY_TYPES), None).when(doc_type.isin(*HEADER_TYPES), free).otherwise(F.coalesce(labelled, _ordinal(head), below, kinder(head)))


def freeform_fields(lines: Column, keys: Column, contact: Column, contact_keys: Column, most: int = 15) -> Column:
    """Name, school and grade at the top of a free text: the header's pattern, then labels among the first lines, then the grade's place."""
    top, top_keys = F.slice(lines, 1, most), F.slice(keys, 1, most)
    near = lambda f, n: L.near_label(top, top_keys, V.ALIASES[f], n, value_after_label_only=True)
    name = let(near("student_name", 40), lambda v: F.when(~F.lower(v).isin(*V.NAME_LABELS) & P.plausible_name(v), v))
    school = let(near("school_name", 120), lambda v: F.when(P.candidate(v, 120) & ~P.fragment(v), v))
    grade = let(near("grade", 30), lambda v: F.when(v.isNotNull(), X.grade_parse(v)).otherwise(L.near_anchor(top, top_keys)))
    placed = grade_placement(F.lit(HEADER_TYPES[0]), lines, contact, contact_keys)
    return let(L.freeform_header(lines), lambda h: F.struct(F.coalesce(h["student_name"], name).alias("student_name"), F.coalesce(h["school_name"], school).alias("school_name"), F.coalesce(h["grade"], grade, placed).alias("grade")))


def _dated(c: Column) -> Column:
    low = F.lower(c)
    return low.startswith("deadline") | low.rlike(rf"\b{DATED}\b") | (has_any(low, V.MONTHS) & low.rlike(r"\b\d{1,2}\b"))


def _words_ok(c: Column, least: int, most: int) -> Column:
    """So many words, each beginning with a letter."""
    return c.rlike(rf"^\p{{L}}[^\x09-\x0D\x20]*(?:[\x09-\x0D\x20]+\p{{L}}[^\x09-\x0D\x20]*){{{least - 1},{most - 1}}}$")


def _letters(c: Column) -> Column:
    return c.rlike(r"^[\p{L} \-]+$")


def _name_line(c: Column) -> Column:
    """Whether a line of a typed form can be the name itself."""
    low = F.lower(F.translate(c, "’‘", "''"))
    plain = ~(c.contains("@") & c.contains(".")) & ~P.starts_any(low, V.PROSE_STARTS) & ~low.isin(*V.NAME_LABELS) & ~low.startswith("student")
    return (F.length(c) <= 40) & plain & ~P.fragment(c) & P.plausible_name(c) & (_words_ok(c, 2, 5) | (_letters(c) & c.rlike(r"^[^ ]+(?: +[^ ]+){0,2}$")))


def _cut_name(c: Column) -> Column:
    """The part of a line before a grade that stands on it; the line itself if there is none or that part is too long."""
    low = F.lower(c)
    cuts = F.array(*[F.lit(x) for x in V.NAME_CUTS])
    return let(F.get(F.filter(cuts, lambda x: low.contains(x)), 0), lambda x: let(X.trimmed(F.substr(c, F.lit(1), F.instr(low, x) - 1)), lambda part: F.when((part != "") & (F.length(part) <= 40), part).otherwise(c)))


def _zone_label(c: Column) -> Column:
    low = F.lower(c)
    return has_any(low, V.ZONE_LABELS) | (F.length(c) < 2)


def _free_line(c: Column) -> Column:
    """Not a label of a typed form; grades of one or two digits are none."""
    return c.rlike(DIGITS.replace("0?", "")) | ~_zone_label(c)


def _school_line(c: Column, name: Column, least: int) -> Column:
    """A school among lines without labels, in title case if it has no capital at all."""
    usable = _free_line(c) & F.length(c).between(4, 80) & ~c.contains("@") & ~c.rlike("^[1-9]") & ~c.rlike(r"^\p{Nd}+$") & ~P.fragment(c) & P.candidate(c, 80)
    other = (F.lower(c) != F.lower(F.coalesce(name, F.lit("")))) & ~F.lower(c).contains("a dog") & ~_dated(c)
    n = F.regexp_count(c, F.lit(r"[^\x09-\x0D\x20]+"))
    capital = c.rlike(r"(?<![^\x09-\x0D\x20])\p{Lu}")
    titled = F.array_join(F.transform(X.words(c), X.capitalized), " ")
    shown = F.when(capital | (n == 1), c).when(F.lit(least == 1) & c.rlike(r"^[\p{L}\x09-\x0D\x20]+$"), titled)
    return F.when(usable & other & n.between(least, 8), shown)


def _scavenged(c: Column) -> Column:
    """A name further below its label: one capitalized word, two glued together, or two to five words."""
    glued = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    split = c.rlike(r"^\p{L}{8,25}$") & glued.rlike(r"^\p{Lu}[^ ]*(?: \p{Lu}[^ ]*){1,3}$")
    one = c.rlike(r"^(?=.{4,25}$)\p{Lu}[\p{L}'\-]*$")
    several = _words_ok(c, 2, 5) & P.plausible_name(c)
    usable = ~_zone_label(c) & (F.length(c) <= 40) & ~c.contains("@") & ~P.fragment(c)
    return F.when(usable & split & P.candidate(glued, 40) & P.plausible_name(glued), glued).when(usable & (one | several) & P.candidate(c, 40), c)


def typed_zone(docs: DataFrame) -> DataFrame:
    """docs (with lines and keys of contact and text together) and zone: what typed forms say, by the zones of their first page; null for other texts.

    The first page ends before the rules. Names: on their label's line at the top; on the three lines below a label; after the
    footnote; further below the label; else the last line that can be one. Grades and schools: by label at the top, else from
    the last twenty lines upwards, else below their label. E-mail, phone and father figure stand on their labels' lines before the footnote.
    """
    lines, page, top, keys = F.col("__lines"), F.col("__page"), F.col("__top"), F.col("__keys")
    rules = L.first_place(F.col("lines"), lambda x: has_any(F.lower(x), V.RULES_PAGE))
    steps = docs.withColumn("__typed", S.typed_form(F.col("text")) & (F.size("lines") >= 5))
    steps = steps.withColumn("__lines", F.when(F.col("__typed"), F.col("lines"))).withColumn("__rules", F.when(F.col("__typed"), rules)).withColumn("__foot", L.first_place(lines, lambda x: has_any(F.lower(x), V.FOOTNOTE)))
    steps = steps.withColumn("__page", F.when(F.col("__rules") >= 5, F.slice(lines, F.lit(1), F.greatest(F.col("__rules"), F.lit(0)))).otherwise(lines))
    n = F.least(F.lit(20), F.greatest(F.lit(10), F.floor(F.size(page) / 2).cast("int")))
    foot = F.col("__foot")
    bottom = F.when(foot > 3, F.slice(lines, F.greatest(foot - 7, F.lit(1)), F.least(foot, F.lit(8)))).otherwise(F.slice(lines, n + 1, F.lit(10)))
    steps = steps.withColumn("__top", F.slice(page, F.lit(1), n)).withColumn("__bottom", bottom).withColumn("__tail", F.when(F.size(page) >= 15, F.slice(page, F.greatest(F.size(page) - 19, F.lit(1)), F.lit(20))))
    steps = steps.withColumn("__keys", L.folded_all(top)).withColumn("__bottom_keys", L.folded_all(F.col("__bottom")))

    label_at = lambda low: has_any(F.translate(low, "’", "'"), V.NAME_LABELS)
    own = let(
        L.near_label(top, keys, V.ALIASES["student_name"], 40, same_line_only=True),
        lambda v: let(F.lower(F.translate(v, "’", "'")), lambda low: F.when(~low.isin(*V.NAME_LABELS) & ~low.startswith("/ ") & ~has_any(low, ("nombre del estudiante", "/ escuela", *V.NOT_NAMES)) & P.candidate(v, 40) & P.plausible_name(v), v)),
    )
    usable = lambda x: F.when(x.isNotNull(), let(_cut_name(x), lambda c: F.when(_name_line(c), c)))
    below = L.first(F.transform(page, lambda x, i: F.when(label_at(F.lower(x)), F.coalesce(*[usable(F.get(page, i + k)) for k in (1, 2, 3)]))))
    stops = lambda x: (F.length(x) <= 40) & ((x.contains("@") & x.contains(".")) | P.starts_any(F.lower(x), V.PROSE_STARTS[:7]))
    after = let(F.slice(page, F.coalesce(L.first_place(page, lambda x: F.lower(x).contains(V.FOOTNOTE[1])), F.size(page)) + 2, F.lit(3)), lambda three: L.first(F.transform(F.slice(three, F.lit(1), F.coalesce(L.first_place(three, stops), F.lit(3))), lambda x: F.when(_name_line(x), x))))
    named = L.first_place(F.slice(page, 1, 40), lambda x: let(F.lower(x), lambda low: (low.contains("student") & low.contains("name")) | low.contains("nombre del estudiante")))
    further = let(named, lambda at: F.when(at.isNotNull(), L.first(F.transform(F.slice(page, at + 2, F.greatest(F.lit(39) - at, F.lit(0))), _scavenged))))
    ending = L.last(F.transform(page, lambda x: F.when((F.length(x) <= 40) & ~x.contains("@") & _words_ok(x, 2, 4) & _letters(x) & _name_line(x) & P.candidate(x, 40), x)))
    name = let(F.coalesce(own, below, after, further, ending), lambda v: F.when(~has_any(F.lower(F.translate(v, "’", "'")), V.NOT_NAMES), v))
    steps = steps.withColumn("__name", F.when(F.col("__typed"), name))

    tail = F.reverse(F.col("__tail"))
    graded = lambda x: F.when(_free_line(x), X.grade_parse(x))
    beyond = lambda words, use: let(L.first_place(page, lambda x: has_any(F.lower(x), words)), lambda at: F.when(at.isNotNull(), L.first(F.transform(F.slice(page, at + 2, F.size(page)), use))))
    grade = F.coalesce(let(L.near_label(top, keys, V.ALIASES["grade"], 30), lambda v: F.when(v.isNotNull(), X.grade_parse(v)).otherwise(L.near_anchor(top, keys))), L.first(F.transform(tail, graded)), beyond(("grade", "grado"), graded))

    unfit = lambda v: F.lower(v).isin(*V.NOT_SCHOOLS) | F.lower(v).contains("a dog") | _dated(v)
    labelled = let(L.near_label(top, keys, V.ALIASES["school_name"]), lambda v: F.when(~unfit(v), v))
    pattern = r"(?i)(?:school *\/? *escuela|escuela *\/? *school) *[:\-]? *(.+)$"
    following = lambda i: let(F.get(top, i + 1), lambda y: F.when(~_dated(y), y))
    joined = L.first(F.transform(top, lambda x, i: F.when(has_any(F.lower(x), ("school", "escuela")), let(F.coalesce(F.nullif(X.trimmed(F.regexp_extract(x, pattern, 1)), F.lit("")), following(i)), lambda v: F.when(~_dated(v) & ~P.fragment(v) & P.candidate(v, 80), v)))))
    student = F.col("__name")
    school = let(
        F.coalesce(let(F.coalesce(labelled, joined), lambda v: F.when(P.candidate(v, 80) & ~P.fragment(v), v)), L.first(F.transform(tail, lambda x: _school_line(x, student, 1))), beyond(("school", "escuela"), lambda x: _school_line(x, student, 2))),
        lambda v: F.when(~unfit(v), v),
    )
    at_bottom = lambda f, most: L.near_label(F.col("__bottom"), F.col("__bottom_keys"), V.ALIASES[f], most, same_line_only=True)
    figure = let(at_bottom("father_figure_name", 80), lambda v: F.when(~has_any(F.lower(v), (" is ", " was ", " he ", " she ", " my father ", " my mother ")) & (F.size(X.words(v)) <= 5), v))
    typed = F.col("__typed")
    steps = steps.withColumns(
        {
            "__grade": F.when(typed, grade),
            "__school": F.when(typed, school),
            "__email": F.when(typed, let(at_bottom("email", 80), lambda v: F.when(v.contains("@") & v.contains("."), v))),
            "__phone": F.when(typed, at_bottom("phone", 30)),
            "__father": F.when(typed, figure),
        }
    )
    swapped = F.coalesce(has_any(F.lower(student), V.SWAP_SIGNS) & P.plausible_name(F.col("__school"), 80), F.lit(False))
    steps = steps.withColumn("__swap", swapped)
    pick = lambda a, b: F.when(F.col("__swap"), F.col(b)).otherwise(F.col(a))
    zone = F.when(typed, F.struct(pick("__name", "__school").alias("student_name"), pick("__school", "__name").alias("school_name"), F.col("__grade").alias("grade"), F.col("__email").alias("email"), F.col("__phone").alias("phone"), F.col("__father").alias("father_figure_name")))
    return steps.withColumn("zone", zone).drop("__lines", "__rules", "__foot", "__page", "__top", "__bottom", "__tail", "__keys", "__bottom_keys", "__name", "__grade", "__school", "__email", "__phone", "__father", "__swap")


def _refused_name(v: Column) -> Column:
    low = F.lower(F.translate(v, "’", "'"))
    return has_any(low, V.NOT_NAMES + V.ADMIN_TEXTS) | low.rlike(r"\bdue +by\b") | P.fragment(v)


def _refused_school(v: Column) -> Column:
    return F.lower(v).isin(*V.NOT_SCHOOLS) | F.lower(v).contains("a dog") | P.fragment(v)


def _kept(struct: Column, refused) -> Column:
    return let(struct, lambda s: F.when(~refused(s["value"]), s))


FORM_KEYS = {"student_name": "Student's Name", "school_name": "School", "grade": "Grade", "father_figure_name": "Dad's Name"}


def merged_fields(docs: DataFrame) -> DataFrame:
    """Fields by precedence of the extractors, and which gave each.

    docs has lines and keys (contact and text together), contact, contact_keys, form (a map, or null), filename, doc_type and text. A form's own fields come first. Then
    typed forms: zones, a grade's place, a name in the file's name. Other texts: header heuristics, a grade's place, labels of the contact lines,
    an unlabelled header. Labels and pieces of sentences are refused at the end.
    """
    zoned = typed_zone(docs)
    typed, zone = F.col("__typed"), F.col("zone")
    contact, contact_keys = F.col("contact"), F.col("contact_keys")
    steps = zoned.withColumns(
        {
            "__free": F.when(~typed, freeform_fields(F.col("lines"), F.col("keys"), contact, contact_keys)),
            "__bare": F.when(~typed, L.unlabeled_header(F.col("lines"))),
            "__fallback": F.struct(*[v.alias(k) for k, v in L.contact_fallbacks(contact).items()]),
        }
    )
    label = F.when(~typed, let(L.near_label(contact, contact_keys, V.ALIASES["student_name"], 40, value_after_label_only=True), lambda v: F.when(~F.lower(v).isin(*V.NAME_LABELS) & ~P.fragment(v) & P.plausible_name(v), v)))
    placed = lambda kind: grade_placement(kind, F.col("lines"), contact, contact_keys)
    whole = lambda v: F.when(~P.fragment(v), v)
    given = {k: F.nullif(X.trimmed(F.try_element_at("form", F.lit(f))), F.lit("")) for k, f in FORM_KEYS.items()}
    file = F.when(typed, P.name_from_file(F.col("filename")))
    titled = lambda v: F.when(F.lower(v) != "fatherhood essay", v)
    sources = {
        "student_name": (("form", F.when(~has_any(F.lower(given["student_name"]), V.NOT_NAMES), given["student_name"])), ("typed", titled(zone["student_name"])), ("heuristic", whole(F.col("__free.student_name"))), ("label", label), ("unlabeled", whole(F.col("__bare.student_name"))), ("file", file)),
        "school_name": (("form", F.when(~_refused_school(given["school_name"]), given["school_name"])), ("typed", zone["school_name"]), ("heuristic", F.col("__free.school_name")), ("unlabeled", F.col("__bare.school_name"))),
        "grade": (("form", X.grade_extract(given["grade"])), ("typed", zone["grade"]), ("heuristic", F.col("__free.grade")), ("placement", placed(F.when(typed, "ifi_official_form_filled").otherwise(F.col("doc_type")))), ("unlabeled", F.col("__bare.grade"))),
    }
    refusals, chosen = {"student_name": _refused_name, "school_name": _refused_school}, {}
    for field, options in sources.items():
        struct = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("source"))) for k, v in options])
        chosen[field] = _kept(struct, refusals[field]) if field in refusals else struct
    steps = steps.withColumns({f"__{k}": v for k, v in chosen.items()})
    columns = [c for k in sources for c in (F.col(f"__{k}.value").alias(k), F.col(f"__{k}.source").alias(f"{k}_source"))]
    more = {"father_figure_name": F.coalesce(given["father_figure_name"], zone["father_figure_name"]), "phone": F.coalesce(zone["phone"], F.col("__fallback.phone")), "email": F.coalesce(zone["email"], F.col("__fallback.email"))}
    return steps.select("doc_id", *columns, *[v.alias(k) for k, v in more.items()])


def records(s, d) -> DataFrame:
    """Form texts with what the merge needs."""
    i = F.col("doc_id")
    name = F.concat(T.pick(T.FIRST_NAMES, i % 8), F.lit("-"), T.pick(T.LAST_NAMES, F.floor(i / 8) % 8))
    form = F.when(i % 11 == 0, F.create_map(F.lit("Student's Name"), F.when(i % 22 == 0, "Nombre del Padre").otherwise(F.concat(F.lit("Form "), F.col("source"))), F.lit("Grade"), (i % 14).cast("string"), F.lit("School"), F.lit(""), F.lit("Dad's Name"), F.lit("Otto Reed")))
    texts = L.forms(s, d).select("doc_id", "text", F.col("worded").alias("contact"), F.col("keys").alias("contact_keys"), F.concat("worded", "all").alias("lines"), form.alias("form"), F.concat(name, F.lit("-26-Essay.pdf")).alias("filename"), T.pick(T.DOC_TYPES, i % 9).alias("doc_type"))
    return texts.withColumn("keys", L.folded_all(F.slice("lines", 1, 15)))


def _struct(column, *names):
    return [F.col(f"{column}.{n}").alias(n) for n in names]


THREE = ("student_name", "school_name", "grade")
ZONE = THREE + ("email", "phone", "father_figure_name")
QUERIES = {
    "grade_placement": lambda s, d: records(s, d).select("doc_id", grade_placement(F.col("doc_type"), F.col("lines"), F.col("contact"), F.col("contact_keys")).alias("grade")),
    "freeform_fields": lambda s, d: records(s, d).select("doc_id", freeform_fields(F.col("lines"), F.col("keys"), F.col("contact"), F.col("contact_keys")).alias("h")).select("doc_id", *_struct("h", *THREE)),
    "typed_zone_fields": lambda s, d: typed_zone(records(s, d)).select("doc_id", F.col("__typed").alias("typed"), *_struct("zone", *ZONE)),
    "fields_merge": lambda s, d: merged_fields(records(s, d)),
}

# The same as SQL, in steps.

_let, _Q = P.sql_let, P.quote
_STRAIGHT = _Q("''")


def _re(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_Q(pattern)})"


def _sql_found(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract(coalesce({c}, ''), {_Q(pattern)}, 1), '')"


def _sql_ordinal(c: str) -> str:
    return "coalesce(" + ", ".join(_sql_found(c, p) for p in ORDINALS) + ")"


def sql_placement(doc_type: str, lines: str, contact: str, keys: str) -> str:
    head = f"array_to_string({lines}[1:6], chr(10))"
    kinder = lambda c: f"case when {_re(c, KINDER)} then 'K' end"
    single = L.sql_first(L.sql_each(f"{lines}[1:4]", lambda x: _sql_found(x, DIGITS)))
    free = _let(head, lambda h: f"coalesce({_sql_ordinal(h)}, {kinder(h)}, {single})")
    below = L.sql_first(L.sql_each(f"range(1, len({lines}) + 1)", lambda i: f"case when {_re(f'{lines}[{i}]', '(?i)grade|grado')} and not {_re(f'{lines}[{i}]', '[0-9]')} then coalesce({_sql_found(f'{lines}[{i} + 1]', DIGITS)}, {_sql_ordinal(f'{lines}[{i} + 1]')}) end"))
    labelled = f"coalesce({_let(L.sql_near(contact, keys, V.ALIASES['grade'], 30, after_only=True), P.sql_grade)}, {L.sql_anchor(contact, keys)})"
    return f"case when {P.sql_in(doc_type, EMPTY_TYPES)} then null when {P.sql_in(doc_type, HEADER_TYPES)} then {free} else coalesce({labelled}, {_sql_ordinal(head)}, {below}, {kinder(head)}) end"


def sql_free_fields(lines: str, keys: str, contact: str, contact_keys: str) -> str:
    top = f"{lines}[1:15]"
    near = lambda f, n: L.sql_near(top, keys, V.ALIASES[f], n, after_only=True)
    name = _let(near("student_name", 40), lambda v: f"case when not {P.sql_in(f'lower({v})', V.NAME_LABELS)} and {P.sql_name(v)} then {v} end")
    school = _let(near("school_name", 120), lambda v: f"case when {P.sql_candidate(v, 120)} and not {P.sql_fragment(v)} then {v} end")
    grade = _let(near("grade", 30), lambda v: f"case when {v} is not null then {P.sql_grade(v)} else {L.sql_anchor(top, keys)} end")
    placed = sql_placement(_Q(HEADER_TYPES[0]), lines, contact, contact_keys)
    return _let(L.sql_freeform(lines), lambda h: f"{{'student_name': coalesce({h}.student_name, {name}), 'school_name': coalesce({h}.school_name, {school}), 'grade': coalesce({h}.grade, {grade}, {placed})}}")


def _sql_dated(c: str) -> str:
    return f"(starts_with(lower({c}), 'deadline') or {_re(f'lower({c})', rf'{chr(92)}b{DATED}{chr(92)}b')} or ({P.sql_any(f'lower({c})', V.MONTHS)} and {_re(f'lower({c})', rf'{chr(92)}b[0-9]{{1,2}}{chr(92)}b')}))"


def _sql_count(c: str) -> str:
    return f"len({P.sql_words(c)})"


def _sql_words_ok(c: str, least: int, most: int) -> str:
    return f"({_sql_count(c)} between {least} and {most} and not {P.sql_some(P.sql_words(c), lambda w: 'not ' + _re(w, '^' + chr(92) + 'pL'))})"


def _sql_letters(c: str) -> str:
    return f"regexp_full_match({c}, '[\\pL \\-]+')"


def _low(c: str) -> str:
    return f"lower(translate({c}, '’‘', {_STRAIGHT}))"


def _sql_name_line(c: str) -> str:
    plain = f"not (contains({c}, '@') and contains({c}, '.')) and not {P.sql_any(_low(c), V.PROSE_STARTS, 'starts_with')} and not {P.sql_in(_low(c), V.NAME_LABELS)} and not starts_with({_low(c)}, 'student')"
    return f"(length({c}) <= 40 and {plain} and not {P.sql_fragment(c)} and {P.sql_name(c)} and ({_sql_words_ok(c, 2, 5)} or ({_sql_letters(c)} and {_sql_count(c)} <= 3)))"


def _sql_cut_name(c: str) -> str:
    cuts = "[" + ", ".join(map(_Q, V.NAME_CUTS)) + "]"
    part = lambda x: P.sql_trim(f"substr({c}, 1, strpos(lower({c}), {x}) - 1)")
    return _let(f"list_filter({cuts}, lambda c9: contains(lower({c}), c9))[1]", lambda x: _let(part(x), lambda y: f"case when {y} <> '' and length({y}) <= 40 then {y} else {c} end"))


def _sql_zone_label(c: str) -> str:
    return f"({P.sql_any(f'lower({c})', V.ZONE_LABELS)} or length({c}) < 2)"


def _sql_free_line(c: str) -> str:
    return f"(regexp_full_match({c}, '[1-9]|1[0-2]') or not {_sql_zone_label(c)})"


def _sql_school_line(c: str, name: str, least: int) -> str:
    usable = f"{_sql_free_line(c)} and length({c}) between 4 and 80 and not contains({c}, '@') and not {_re(c, '^[1-9]')} and not regexp_full_match({c}, '\\p{{Nd}}+') and not {P.sql_fragment(c)} and {P.sql_candidate(c, 80)}"
    other = f"lower({c}) <> lower(coalesce({name}, '')) and not contains(lower({c}), 'a dog') and not {_sql_dated(c)}"
    capital = P.sql_some(P.sql_words(c), lambda w: _re(w, "^" + chr(92) + "p{Lu}"))
    titled = f"case when {least} = 1 and regexp_full_match({c}, '[\\pL\\x09-\\x0D\\x20]+') then array_to_string(list_transform({P.sql_words(c)}, lambda t9: upper(t9[1]) || lower(t9[2:])), ' ') end"
    return f"case when {usable} and {other} and {_sql_count(c)} between {least} and 8 then case when {capital} or {_sql_count(c)} = 1 then {c} else {titled} end end"


def _sql_scavenged(c: str) -> str:
    glued = f"regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    split = f"regexp_full_match({c}, '\\pL{{8,25}}') and regexp_full_match({glued}, '\\p{{Lu}}[^ ]*(?: \\p{{Lu}}[^ ]*){{1,3}}')"
    one = f"length({c}) between 4 and 25 and regexp_full_match({c}, '\\p{{Lu}}[\\pL''\\-]*')"
    usable = f"not {_sql_zone_label(c)} and length({c}) <= 40 and not contains({c}, '@') and not {P.sql_fragment(c)}"
    return f"case when {usable} and {split} and {P.sql_candidate(glued, 40)} and {P.sql_name(glued)} then {glued} when {usable} and (({one}) or ({_sql_words_ok(c, 2, 5)} and {P.sql_name(c)})) and {P.sql_candidate(c, 40)} then {c} end"


def _sql_unfit(v: str) -> str:
    return f"({P.sql_in(f'lower({v})', V.NOT_SCHOOLS)} or contains(lower({v}), 'a dog') or {_sql_dated(v)})"


RECORDS = f"""
rc as (select doc_id, text, worded as contact, keys as ckeys, list_concat(worded, alls) as ls, list_transform(list_concat(worded, alls)[1:15], lambda x: {P.sql_folded("x")}) as k15,
  case when doc_id % 22 = 0 then 'Nombre del Padre' when doc_id % 11 = 0 then 'Form ' || source end as f_name, case when doc_id % 11 = 0 then (doc_id % 14)::varchar end as f_grade, case when doc_id % 11 = 0 then 'Otto Reed' end as f_father,
  ({L._LIST(T.FIRST_NAMES)})[doc_id % 8 + 1] || '-' || ({L._LIST(T.LAST_NAMES)})[doc_id // 8 % 8 + 1] || '-26-Essay.pdf' as filename, ({L._LIST(T.DOC_TYPES)})[doc_id % 9 + 1] as doc_type from fm)
"""


def _zone_sql() -> str:
    three = lambda i, use: "coalesce(" + ", ".join(use(f"page[{i} + {k}]") for k in (1, 2, 3)) + ")"
    usable = lambda x: _let(_sql_cut_name(x), lambda c: f"case when {x} is not null and {_sql_name_line(c)} then {c} end")
    own = _let(L.sql_near("top", "tkeys", V.ALIASES["student_name"], 40, same_line=True), lambda v: f"case when not {P.sql_in(_low(v), V.NAME_LABELS)} and not starts_with({_low(v)}, '/ ') and not {P.sql_any(_low(v), ('nombre del estudiante', '/ escuela', *V.NOT_NAMES))} and {P.sql_candidate(v, 40)} and {P.sql_name(v)} then {v} end")
    below = L.sql_first(L.sql_each("range(1, len(page) + 1)", lambda i: f"case when {P.sql_any(_low(f'page[{i}]'), V.NAME_LABELS)} then {three(i, usable)} end"))
    place = L.sql_first_place("page", lambda x: f"contains(lower({x}), {_Q(V.FOOTNOTE[1])})")
    stops = lambda x: f"length({x}) <= 40 and ((contains({x}, '@') and contains({x}, '.')) or {P.sql_any(f'lower({x})', V.PROSE_STARTS[:7], 'starts_with')})"
    after = _let(f"page[coalesce({place}, len(page)) + 1:coalesce({place}, len(page)) + 3]", lambda t: L.sql_first(L.sql_each(f"{t}[1:coalesce({L.sql_first_place(t, stops)} - 1, 3)]", lambda x: f"case when {_sql_name_line(x)} then {x} end")))
    named = L.sql_first_place("page[1:40]", lambda x: f"(contains(lower({x}), 'student') and contains(lower({x}), 'name')) or contains(lower({x}), 'nombre del estudiante')")
    further = _let(named, lambda i: f"case when {i} is not null then {L.sql_first(L.sql_each(f'page[{i} + 1:40]', _sql_scavenged))} end")
    ending = f"list_filter(page, lambda x: length(x) <= 40 and not contains(x, '@') and {_sql_words_ok('x', 2, 4)} and {_sql_letters('x')} and {_sql_name_line('x')} and {P.sql_candidate('x', 40)})[-1]"
    name = _let(f"coalesce({own}, {below}, {after}, {further}, {ending})", lambda v: f"case when not {P.sql_any(_low(v), V.NOT_NAMES)} then {v} end")
    graded = lambda x: f"case when {_sql_free_line(x)} then {P.sql_grade(x)} end"
    beyond = lambda words, use: _let(L.sql_first_place("page", lambda x: P.sql_any(f"lower({x})", words)), lambda i: f"case when {i} is not null then {L.sql_first(L.sql_each(f'page[{i} + 1:]', use))} end")
    near_grade = _let(L.sql_near("top", "tkeys", V.ALIASES["grade"], 30), lambda v: f"case when {v} is not null then {P.sql_grade(v)} else {L.sql_anchor('top', 'tkeys')} end")
    grade = f"coalesce({near_grade}, {L.sql_first(L.sql_each('list_reverse(tail)', graded))}, {beyond(('grade', 'grado'), graded)})"
    labelled = _let(L.sql_near("top", "tkeys", V.ALIASES["school_name"]), lambda v: f"case when not {_sql_unfit(v)} then {v} end")
    pattern = r"(?i)(?:school */? *escuela|escuela */? *school) *[:\-]? *(.+)$"
    value = lambda i: f"coalesce(nullif({P.sql_trim(f'regexp_extract(top[{i}], {_Q(pattern)}, 1)')}, ''), case when not {_sql_dated(f'top[{i} + 1]')} then top[{i} + 1] end)"
    joined = L.sql_first(L.sql_each("range(1, len(top) + 1)", lambda i: f"case when {P.sql_any(f'lower(top[{i}])', ('school', 'escuela'))} then {_let(value(i), lambda v: f'case when not {_sql_dated(v)} and not {P.sql_fragment(v)} and {P.sql_candidate(v, 80)} then {v} end')} end"))
    school = _let(
        f"coalesce({_let(f'coalesce({labelled}, {joined})', lambda v: f'case when {P.sql_candidate(v, 80)} and not {P.sql_fragment(v)} then {v} end')}, {L.sql_first(L.sql_each('list_reverse(tail)', lambda x: _sql_school_line(x, 'z_name', 1)))}, {beyond(('school', 'escuela'), lambda x: _sql_school_line(x, 'z_name', 2))})",
        lambda v: f"case when not {_sql_unfit(v)} then {v} end",
    )
    near = lambda f, most: L.sql_near("bottom", "bkeys", V.ALIASES[f], most, same_line=True)
    email = _let(near("email", 80), lambda v: f"case when contains({v}, '@') and contains({v}, '.') then {v} end")
    figure = _let(near("father_figure_name", 80), lambda v: f"case when not {P.sql_any(f'lower({v})', (' is ', ' was ', ' he ', ' she ', ' my father ', ' my mother '))} and {_sql_count(v)} <= 5 then {v} end")
    low = _low("text")
    kami = f"contains({low}, 'kami')"
    hits = lambda parts: " + ".join(f"contains({low}, {_Q(p)})::int" for p in parts)
    typed = f"length({P.sql_trim('text')}) >= 50 and ((contains({low}, 'ifi') and contains({low}, 'fatherhood')) or {kami}) and ({hits(S.TOP)}) >= 2 and (({hits(S.BOTTOM)}) >= 1 or {kami}) and len(ls) >= 5"
    first = lambda items, parts: L.sql_first_place(items, lambda x: P.sql_any(f"lower({x})", parts))
    swap = f"coalesce({P.sql_any('lower(z_name)', V.SWAP_SIGNS)} and {P.sql_name('z_school', 80)}, false)"
    return f"""
z_0 as (select *, {typed} as typed from rc),
z_1 as (select doc_id, ls, {first("ls", V.RULES_PAGE)} as rules, {first("ls", V.FOOTNOTE)} as foot from z_0 where typed),
z_2 as (select *, case when rules > 5 then ls[1:rules - 1] else ls end as page from z_1),
z_3 as (select *, least(20, greatest(10, len(page) // 2)) as n from z_2),
z_4 as (select *, page[1:n] as top, case when len(page) >= 15 then page[-20:] else [] end as tail, case when foot > 4 then ls[greatest(foot - 8, 1):foot - 1] else ls[n + 1:n + 10] end as bottom from z_3),
z_5 as (select *, list_transform(top, lambda x: {P.sql_folded("x")}) as tkeys, list_transform(bottom, lambda x: {P.sql_folded("x")}) as bkeys from z_4),
z_6 as (select *, {name} as z_name, {grade} as z_grade from z_5),
z_7 as (select *, {school} as z_school from z_6),
z_8 as (select *, {swap} as swap from z_7),
zn as (select doc_id, case when swap then z_school else z_name end as student_name, case when swap then z_name else z_school end as school_name, z_grade as grade, {email} as email, {near("phone", 30)} as phone, {figure} as father_figure_name from z_8)
"""


def _merge_sql() -> str:
    refused = lambda v: f"({P.sql_any(_low(v), V.NOT_NAMES + V.ADMIN_TEXTS)} or {_re(_low(v), chr(92) + 'bdue +by' + chr(92) + 'b')} or {P.sql_fragment(v)})"
    bad_school = lambda v: f"({P.sql_in(f'lower({v})', V.NOT_SCHOOLS)} or contains(lower({v}), 'a dog') or {P.sql_fragment(v)})"
    whole = lambda v: f"case when not {P.sql_fragment(v)} then {v} end"
    label = _let(L.sql_near("contact", "ckeys", V.ALIASES["student_name"], 40, after_only=True), lambda v: f"case when not {P.sql_in(f'lower({v})', V.NAME_LABELS)} and not {P.sql_fragment(v)} and {P.sql_name(v)} then {v} end")
    placed = sql_placement("case when typed then 'ifi_official_form_filled' else doc_type end", "ls", "contact", "ckeys")
    fall = L.sql_contacts("contact")
    sources = {
        "student_name": (("form", f"case when not {P.sql_any('lower(f_name)', V.NOT_NAMES)} then f_name end"), ("typed", "case when lower(z.student_name) <> 'fatherhood essay' then z.student_name end"), ("heuristic", whole("free.student_name")), ("label", "label"), ("unlabeled", whole("bare.student_name")), ("file", f"case when typed then {P.sql_name_from_file('filename')} end")),
        "school_name": (("typed", "z.school_name"), ("heuristic", "free.school_name"), ("unlabeled", "bare.school_name")),
        "grade": (("form", "case when f_grade::int between 1 and 12 then f_grade end"), ("typed", "z.grade"), ("heuristic", "free.grade"), ("placement", "placed"), ("unlabeled", "bare.grade")),
    }
    value = {f: "coalesce(" + ", ".join(f"case when ({v}) is not null then {{'v': {v}, 's': '{k}'}} end" for k, v in options) + ")" for f, options in sources.items()}
    keep = lambda f, test: f"case when not {test(f'{f}.v')} then {f}.v end as {f}, case when not {test(f'{f}.v')} then {f}.s end as {f}_source"
    return f"""
m_0 as (select *, case when not typed then {sql_free_fields("ls", "k15", "contact", "ckeys")} end as free, case when not typed then {L.sql_unlabeled("ls")} end as bare, case when not typed then {label} end as label, {placed} as placed from z_0),
m_1 as (select m.doc_id, {", ".join(f"{v} as {f}" for f, v in value.items())}, coalesce(f_father, z.father_figure_name) as father_figure_name, coalesce(z.phone, {fall["phone"]}) as phone, coalesce(z.email, {fall["email"]}) as email from m_0 m left join zn z using (doc_id))
select doc_id, {keep("student_name", refused)}, {keep("school_name", bad_school)}, grade.v as grade, grade.s as grade_source, father_figure_name, phone, email from m_1"""


_BASE = (L.FORMS, RECORDS)
_ZONE = _zone_sql()
ORACLE = {
    "grade_placement": T.sql(f"select doc_id, {sql_placement('doc_type', 'ls', 'contact', 'ckeys')} as grade from rc", *_BASE),
    "freeform_fields": T.sql(f"h as (select doc_id, {sql_free_fields('ls', 'k15', 'contact', 'ckeys')} as h from rc) select doc_id, h.student_name, h.school_name, h.grade from h", *_BASE),
    "typed_zone_fields": T.sql("select doc_id, typed, student_name, school_name, grade, email, phone, father_figure_name from z_0 left join zn using (doc_id)", *_BASE, _ZONE),
    "fields_merge": T.sql(_merge_sql(), *_BASE, _ZONE),
}
