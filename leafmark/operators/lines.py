"""Field extraction from the lines of form texts.

The lines of a document stay in its row as an array: the first line that meets a condition is an
array position and its neighbours are array elements, so extraction is one projection without an explode, a window or a shuffle,
however large the corpus. Lines are split and folded once per document (see forms()); what an expression
needs more than once is bound by let(), so it is computed once however extractors are composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import accents
from leafmark.functions import fixed as V
from leafmark.functions import plausible as P
from leafmark.functions import text as X
from leafmark.functions.plausible import has_any
from leafmark.functions.text import let
from leafmark.plans import tables as T

ALIASES = V.ALIASES
# What ends an essay.
REACTION = ("reaction to this essay", "reaccion a este ensayo")
FOOTER = ("contest rules", "all rights reserved", "licensed under", "initiative")


def lines_of(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), X.trimmed)


def solid(lines: Column) -> Column:
    return F.filter(lines, lambda x: x != "")


def folded_all(lines: Column) -> Column:
    return F.transform(lines, P.folded)


def first_place(lines: Column, test) -> Column:
    """0-based place of the first line that passes, null if none does."""
    return F.nullif(F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int") - 1


def first(values: Column) -> Column:
    """The first value that is not null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def last(values: Column) -> Column:
    return let(F.filter(values, lambda v: v.isNotNull()), lambda v: F.get(v, F.size(v) - 1))


def folded_text(alias: str) -> str:
    return accents.simple(alias)


def after_colon(line: Column) -> Column:
    return X.trimmed(F.regexp_extract(line, r":([\s\S]*)$", 1))


def _rest(line: Column, alias: Column) -> Column:
    """What follows an alias on its line, without separators."""
    after = F.substr(line, F.instr(F.lower(line), alias) + F.length(alias))
    return X.trimmed(F.regexp_replace(X.trimmed(after), r"^[:/\-]+", ""))


def near_label(lines: Column, keys: Column, aliases: tuple[str, ...], most: int = 60, same_line_only: bool = False, value_after_label_only: bool = False, start: int = 0) -> Column:
    """The value that belongs to the first line that holds any alias; later lines with labels are never tried.

    lines are worded lines, keys the same folded. In order: after a colon; after the alias (and a second alias), up to a slash or another
    label's word; what else the line holds besides the alias; one of the two lines before, if allowed; one of the two after, if allowed. Values
    that speak of a father are refused on the line itself only.
    """
    if start:
        lines, keys = F.slice(lines, start + 1, 1 << 30), F.slice(keys, start + 1, 1 << 30)
    pairs = F.array(*[F.struct(F.lit(folded_text(a)).alias("key"), F.lit(a).alias("raw")) for a in aliases])
    around = [] if same_line_only else ([] if value_after_label_only else ["before_1", "before_2"]) + ["after_1", "after_2"]
    places = {"before_1": -1, "before_2": -2, "after_1": 1, "after_2": 2}
    bare = lambda c: X.trimmed(F.regexp_replace(X.trimmed(c), r"^[:/\-]+", ""))
    # Up to the first slash or word of another label; what is left may hold several blanks, which are made one.
    cut = lambda c: X.trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"/[\s\S]*$", ""), r"(?i)(?<![^\x09-\x0D\x20])(?:grado|grade|escuela|school)[.,:;]*(?![^\x09-\x0D\x20])[\s\S]*$", ""), rf"{X.SPACE}+", " "))

    def hit(at: Column) -> Column:
        key = F.get(keys, at)
        alias = F.get(F.filter(pairs, lambda q: key.contains(q["key"])), 0)
        return F.when(at.isNotNull(), F.struct(F.get(lines, at).alias("line"), F.lower(F.get(lines, at)).alias("low"), key.alias("key"), alias.alias("alias"), *[F.get(lines, at + places[k]).alias(k) for k in around]))

    def pieces(h: Column) -> Column:
        line, key, low, alias = h["line"], h["key"], h["low"], h["alias"]
        rest = F.when(low.contains(alias["raw"]), _rest(line, alias["raw"]))
        at = F.instr(key, alias["key"])
        left = bare(F.concat(F.substr(key, F.lit(1), at - 1), F.substr(key, at + F.length(alias["key"]))))
        variants = F.transform(F.filter(pairs, lambda q: key.contains(q["key"]) & low.contains(q["raw"])), lambda q: _rest(line, q["raw"]))
        kept = [h[k] for k in around] + [alias["raw"].alias("raw")]
        return F.struct(after_colon(line).alias("colon"), rest.alias("rest"), F.lower(rest).alias("low"), left.alias("left"), variants.alias("variants"), *kept)

    def value(v: Column) -> Column:
        second = F.get(F.filter(pairs, lambda q: v["low"].contains(q["raw"]) & (q["raw"] != v["raw"])), 0)["raw"]
        after = cut(F.coalesce(_rest(v["rest"], second), v["rest"]))
        return P.judged([(v["colon"], 60), (after, most), (v["left"], most)] + [(v[k], most) for k in around], v["variants"], most)

    def chosen(j: Column) -> Column:
        at = lambda k: F.get(j, k)
        near = [at(3 + k)["ok"] for k in range(len(around))]
        variants = F.filter(F.slice(j, 4 + len(around), 1 << 30), lambda x: x["good"].isNotNull())
        on_line = F.coalesce(F.get(variants, 0)["good"], at(2)["good"])
        return F.coalesce(at(0)["good"], at(1)["good"], F.when(at(2)["ok"].isNotNull(), on_line).otherwise(F.coalesce(*near, F.lit(None).cast("string"))))

    at = first_place(keys, lambda k: has_any(k, tuple(map(folded_text, aliases))))
    return let(let(let(let(at, hit), pieces), value), chosen)


def near_anchor(lines: Column, keys: Column, reach: int = 3) -> Column:
    """The first grade within some lines of a grade label; labels and lines in order."""
    places = F.filter(F.transform(keys, lambda k, i: F.when(has_any(k, ("grade", "grado")), i)), lambda i: i.isNotNull())
    around = lambda i: F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, F.size(lines) - 1))
    return first(F.transform(places, lambda i: first(F.transform(around(i), lambda j: X.grade_parse(F.get(lines, j))))))


def _by_colon(lines: Column, keys: Column, words: tuple[str, ...]) -> Column:
    return first(F.zip_with(lines, keys, lambda line, key: F.when(has_any(key, words), let(after_colon(line), lambda c: F.when(P.candidate(c), c)))))


def fields_rules(lines: Column, keys: Column) -> dict[str, Column]:
    """Eight fields of a block of lines, by their labels; values stand after labels only."""
    near = lambda f, most=60: near_label(lines, keys, ALIASES[f], most, value_after_label_only=True)
    return {
        "student_name": near("student_name"),
        "school_name": near("school_name"),
        "grade": F.coalesce(X.grade_parse(near("grade", 30)), near_anchor(lines, keys)),
        "teacher_name": _by_colon(lines, keys, ("teacher", "maestro")),
        "city_or_location": _by_colon(lines, keys, ("city", "location", "ciudad")),
        "father_figure_name": near("father_figure_name", 80),
        "phone": near("phone", 30),
        "email": near("email", 80),
    }


GRADE_LINE = r"(?i)\b(1[0-2]|[1-9])(?:st|nd|rd|th)?[ ]*grade\b"


def header_regex(c: Column) -> dict[str, Column]:
    """Name, grade and school by patterns over the whole text."""
    value = lambda p: F.nullif(X.trimmed(F.regexp_extract(c, p, 1)), F.lit(""))
    return {
        "student_name": value(r"(?i)student'?s? name *: *([^\n]{2,60})"),
        "grade": value(r"(?i)(?:grade|grado) *:? *(1[0-2]|[1-9]|k)\b"),
        "school_name": value(r"(?i)(?:school|escuela) *: *([^\n]{3,80})"),
    }


SCHOOL_GRADE = r"(?i)^(.+?)[ ]+(\d{1,2})(?:st|nd|rd|th)?[ ]*grade$"


def freeform_header(lines: Column, n: int = 12) -> Column:
    """Name, school and grade: a name line followed by `School Nth grade` among the first n lines, else among the last n."""

    def region(part: Column) -> Column:
        rest = F.greatest(F.size(part) - 1, F.lit(0))
        school = lambda p: X.trimmed(F.regexp_extract(p["line"], SCHOOL_GRADE, 1))
        grade = lambda p: F.regexp_extract(p["line"], SCHOOL_GRADE, 2).try_cast("int")
        pairs = F.zip_with(F.slice(part, 1, rest), F.slice(part, 2, rest), lambda a, b: F.struct(a.alias("name"), b.alias("line")))
        labels = V.NAME_LABELS + ("school", "grade")
        fit = lambda p: p["line"].rlike(SCHOOL_GRADE) & grade(p).between(1, 12) & (F.length(p["name"]) <= 40) & P.plausible_name(p["name"]) & ~F.lower(p["name"]).isin(*labels) & P.candidate(school(p), 120)
        return let(F.get(F.filter(pairs, fit), 0), lambda p: F.when(p.isNotNull(), F.struct(p["name"].alias("student_name"), school(p).alias("school_name"), grade(p).cast("string").alias("grade"))))

    return F.coalesce(region(F.slice(lines, 1, n)), F.when(F.size(lines) > n, region(F.slice(lines, -n, n))))


def unlabeled_header(lines: Column, n: int = 8) -> Column:
    """Name, school and grade among the first n lines: a name after `Name:`, else a line that can be one; a line with a school's word; `Nth grade`."""
    words = ("student", "grade", "school", "escuela", "name", "nombre", "essay", "father")
    named = lambda x: let(X.trimmed(F.regexp_extract(x, r"(?i)^(?:name|nombre)[ ]*[:\-][ ]*(.+)$", 1)), lambda v: F.when((v != "") & (F.length(v) <= 40) & ~F.lower(x).contains("father") & P.plausible_name(v), v))
    plain = lambda x: (F.length(x) <= 40) & ~has_any(F.lower(x), words) & ~P.fragment(x) & P.plausible_name(x) & P.candidate(x, 40)
    school = lambda x: F.length(x).between(4, 120) & has_any(F.lower(x), V.HEADER_SCHOOLS) & ~F.lower(x).isin("school", "escuela", "school name") & P.candidate(x, 120) & ~P.fragment(x)
    pick = lambda top, test: F.get(F.filter(top, test), 0)
    grade = lambda top: F.nullif(F.regexp_extract(F.coalesce(pick(top, lambda x: x.rlike(GRADE_LINE)), F.lit("")), GRADE_LINE, 1), F.lit(""))
    return let(F.slice(lines, 1, n), lambda top: F.struct(F.coalesce(first(F.transform(top, named)), pick(top, plain)).alias("student_name"), pick(top, school).alias("school_name"), grade(top).alias("grade")))


def grade_wide(lines: Column, reach: int = 10) -> Column:
    """A grade on the first label line, else on the first of the next lines that holds one and speaks of no date or contest."""

    def near(at: Column) -> Column:
        own = F.nullif(F.regexp_extract(F.get(lines, at), r"\b(1[0-2]|[1-9])(?:st|nd|rd|th)?\b", 1), F.lit(""))
        after = F.when(at.isNotNull(), F.slice(lines, at + 2, reach))
        good = F.filter(after, lambda x: x.rlike(r"^(?:1[0-2]|[1-9])(?:st|nd|rd|th)?$") & ~F.lower(x).rlike("contest|deadline|date"))
        return F.coalesce(own, F.nullif(F.regexp_extract(F.get(good, 0), r"^(1[0-2]|[1-9])", 1), F.lit("")))

    return let(first_place(lines, lambda x: F.lower(x).rlike(r"\b(?:grade|grado)\b")), near)


def strip_footer(lines: Column) -> Column:
    """Text without what follows the last reaction prompt and without boilerplate lines at its end."""

    def body(ls: Column) -> Column:
        cut = F.array_max(F.transform(ls, lambda x, i: F.when(has_any(F.lower(x), REACTION), i)))
        return let(cut, lambda c: F.when(c.isNull(), ls).otherwise(F.slice(ls, 1, c)))

    def peeled(b: Column) -> Column:
        keep = F.transform(b, lambda x, i: F.when((x != "") & ~has_any(F.lower(x), FOOTER) & ~((F.length(x) <= 3) & ~x.rlike("^[A-Za-z]")), i + 1))
        return X.trimmed(F.array_join(F.slice(b, 1, F.coalesce(F.array_max(keep), F.lit(0))), "\n"))

    return let(let(lines, body), peeled)


def contact_split(lines: Column, most: int = 50, least: int = 6) -> Column:
    """(contact, essay): arrays of lines. Contact lines go on while labels, prompts and short lines do.

    The essay begins at a long line after the prompt's choices, at the second long line after an essay mark, or at a run of three
    long lines beyond the thirtieth; label words of a sentence count on short lines only. The fold runs over the first lines only.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(3).alias("end"), F.lit(False).alias("prompt"), F.lit(False).alias("mark"), F.lit(0).alias("run"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        def next_state(key: Column) -> Column:
            at, end = s["at"], s["end"]
            longer = F.greatest(end, at + 1)
            state = lambda end, run=F.lit(0), prompt=s["prompt"], mark=s["mark"], done=F.lit(False): F.struct((at + 1).alias("at"), end.alias("end"), prompt.alias("prompt"), mark.alias("mark"), run.alias("run"), done.alias("done"))
            contact = has_any(key, V.CONTACT_STRICT) | ((F.length(x) <= 80) & has_any(key, V.CONTACT_LOOSE))
            run = s["run"] + 1
            return (
                F.when(s["done"], s)
                .when(x == "", state(end))
                .when(has_any(key, V.PROMPT_MARKS), state(longer, prompt=F.lit(True)))
                .when(has_any(key, V.ESSAY_MARKS), state(longer, mark=F.lit(True)))
                .when(contact, state(longer))
                .when(s["prompt"] & (F.length(x) > 30), state(at, done=F.lit(True)))
                .when(F.length(x) <= 40, state(longer))
                .when(s["mark"] & (run >= 2), state(F.greatest(end, at - 1), done=F.lit(True)))
                .when((at > 30) & (run >= 3), state(at - 2, done=F.lit(True)))
                .otherwise(state(end, run))
            )

        return let(P.folded(x), next_state)

    def parts(end: Column) -> Column:
        return F.struct(F.slice(lines, 1, end).alias("contact"), F.slice(lines, end + 1, 1 << 30).alias("essay"))

    folded = F.aggregate(F.slice(lines, 1, most), start, step)
    return let(F.when(F.size(lines) <= 3, F.size(lines)).otherwise(F.greatest(folded["end"], F.lit(least))), parts)


PHONE = (r"(\d{3}[-. ]?\d{3}[-. ]?\d{4})", r"(\(\d{3}\) ?\d{3}[-. ]?\d{4})")
MAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
SCHOOL_WORD = r"(?i)\b(?:Elementary|Middle|High|School|Academy|Academia|Escuela)\b"


def _cleaned(c: Column) -> Column:
    return F.array_join(X.words(F.regexp_replace(c, r"[^\p{L}\p{N}_ \-&]", "")), " ")


def contact_fallbacks(lines: Column) -> dict[str, Column]:
    """Phone, e-mail and school of contact lines: on a label's line or on the two after it; a school up to three lines around its label, else anywhere."""
    found = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))

    def labelled(words: tuple[str, ...], own, after) -> Column:
        return first(F.transform(lines, lambda x, i: F.when(has_any(F.lower(x), words), F.coalesce(own(x), after(F.get(lines, i + 1)), after(F.get(lines, i + 2))))))

    def own_phone(x: Column) -> Column:
        number = F.regexp_replace(found(x, r"(?i)(?:phone|tel[eé]fono|tel)[: ]+([0-9 \-().]+)"), r"[^\d\-().]", "")
        return let(number, lambda v: F.when(F.length(F.regexp_replace(v, r"[^\d]", "")) >= 10, v))

    def school(x: Column) -> Column:
        whole = let(_cleaned(x), lambda c: F.when(x.rlike(SCHOOL_WORD) & (F.length(c) > 3), c))
        named = F.when(x.rlike(r"^[A-Z][a-z]+(?: +[A-Z][a-z]+){1,4}$"), x)
        return F.when(F.length(x) >= 3, F.coalesce(whole, named))

    def around(i: Column) -> Column:
        others = F.filter(F.sequence(F.greatest(i - 3, F.lit(0)), F.least(i + 3, F.size(lines) - 1)), lambda j: j != i)
        return first(F.transform(others, lambda j: school(F.get(lines, j))))

    near = first(F.transform(lines, lambda x, i: F.when(has_any(F.lower(x), ("school", "escuela")), around(i))))
    wide = first(F.transform(lines, lambda x: F.when((F.length(x) >= 5) & x.rlike(SCHOOL_WORD), let(_cleaned(x), lambda c: F.when(((F.length(c) > 8) & ~F.lower(c).contains("school")) | (F.size(X.words(c)) > 1), c)))))
    return {
        "phone": labelled(("phone", "teléfono", "telefono", "tel"), own_phone, lambda y: F.coalesce(*[found(y, p) for p in PHONE])),
        "email": labelled(("email", "correo", "e-mail"), lambda x: found(x, r"(?i)(?:email|correo|e-mail)[: ]+" + MAIL), lambda y: found(y, MAIL)),
        "school_name": F.coalesce(near, wide),
    }


def fallback_record(forms: DataFrame) -> DataFrame:
    """What is known of a document without any extraction, with notes."""
    body = F.length(F.regexp_replace("text", r"[\x09-\x0D\x20]+", ""))
    notes = F.array_compact(F.array(F.when(body < 50, "template_blank"), F.when(F.lower("text").contains("student"), "has_label"), F.lit("fallback")))
    return forms.select("doc_id", (body < 50).alias("is_blank"), F.array_join(notes, ",").alias("notes"))


def form_map_fields(maps: DataFrame) -> DataFrame:
    """Name, school and grade from a form's key-value pairs by the words in their keys; label values are rejected."""
    labels = ("student's name", "student name", "nombre del estudiante", "grade", "grado", "school", "escuela", "phone", "telefono", "email", "correo")
    entries = F.filter(F.map_entries("form"), lambda e: (e["value"] != "") & ~F.lower(e["value"]).isin(*labels))
    pick = lambda *w: F.get(F.transform(F.filter(entries, lambda e: has_any(F.lower(e["key"]), w)), lambda e: e["value"]), 0)
    return maps.select("doc_id", pick("student", "estudiante").alias("student_name"), pick("school", "escuela").alias("school_name"), pick("grade", "grado").alias("grade"))


def start_page_guard(pages: DataFrame) -> DataFrame:
    """Per document the header fields of its first page; fields seen on later pages only are cleared and listed."""
    names = ("student_name", "grade")
    found = pages.select("doc_id", "page_index", *[v.alias(k) for k, v in header_regex(F.col("text")).items() if k in names])
    first_page = found.groupBy("doc_id").agg(F.min("page_index").alias("__first"))
    rows = found.join(first_page, "doc_id")
    on = F.col("page_index") == F.col("__first")
    agg = rows.groupBy("doc_id").agg(*[F.max(F.when(on, F.col(c))).alias(c) for c in names], *[F.max(F.when(~on, F.col(c))).alias(f"__{c}") for c in names])
    risk = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"__{c}").isNotNull(), c) for c in names]))
    return agg.select("doc_id", *names, F.array_join(risk, ",").alias("risk"))


# Form texts: documents with a header of one of these layouts before their text, and a footer after some.
LAYOUTS = (
    "Student's Name: {name}\nGrade: {grade}\nSchool: {school}\nTeacher: Ms Moss\nCity: Oakton\nFather's Name: {other}\n",
    "Student's Name\n{name}\nGrade\n{grade}\nSchool\n{school}\nPhone: (312) 555-0{tail}\n",
    "{other}\nGrade\n{grade}th\nSchool\n\n{school}\n",
    "{name}\n{school} {grade}th grade\n",
    "",
    "Nombre del Estudiante: {name} / Grado\nEscuela\n{school} Academy\nGrado {grade}\nTeléfono: (312) 555-0{tail}\nCorreo electrónico\nr{tail}@example.org\nPadre: {other}\n",
    "Student: Nombre del Estudiante {name} / Grado\nGrade / Grado\n{grade}\nSchool / Escuela {school} Institute\nEmail: r{tail}@example.org\nPhone\n312-555-0{tail}\n",
    "IFI Fatherhood Essay Contest\nStudent's Name {name}\nGrade {grade}\nSchool {school}\nEmail: r{tail}@example.org\nPhone: 312-555-0{tail}\nFather/Father-Figure Name {other}\n",
    "IFI Fatherhood Essay Contest\nStudent's Name\nDeadline: March 19\nGrade\nSchool\nPhone\nEmail\nFather/Father-Figure Name\n{name}\n{school} School\n{grade}\n",
    "IFI Fatherhood Essay Contest\nStudent's Name / Nombre del Estudiante\nDeadline: March 19\n{name} Grade/Grado {grade}th grade\nSchool\n{school} Elementary\nPhone\nContest Details\nElla Rules\n",
    "IFI Fatherhood Essay Contest\nGrade\nSchool\nWriting about: Father / Padre\nEmail: r{tail}@example.org\nPhone: 312-555-0{tail}\nName of my hero: {other}\n*A Father-Figure can be any of the influential males in your life.\n{name}\n{school} School\n{grade}\nJudging Process\nAda Clark\n",
    "{name}\n{school} Elementary School\nGrade {grade}\nMy father and what he means to me\n",
)
FOOTERS = ("\nReaction to this essay\nyes\nContest rules apply\n", "\nContest rules apply\n--\n", "", "")


def _filled(template: str, values: dict[str, Column]) -> Column:
    pieces = [p for p in template.replace("}", "{").split("{") if p]
    return F.concat(F.lit(""), *[values.get(p, F.lit(p)) for p in pieces])


def forms(s, d) -> DataFrame:
    """Form texts with the text they were made from (body) and their lines: as they are (lines), worded ones (all), contact and essay (split), and the contact's worded lines (worded), also folded (keys)."""
    docs, customers, nations = T.read(s, d, "documents"), T.read(s, d, "customer"), T.read(s, d, "nation")
    joined = docs.join(customers.select(F.col("c_custkey").alias("doc_id"), "c_nationkey"), "doc_id", "left").join(F.broadcast(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey", "left")
    i = F.col("doc_id")
    place = F.initcap(F.coalesce("n_name", F.lit("Hill")))
    values = {
        "name": F.concat(T.pick(T.FIRST_NAMES, i % 8), F.lit(" "), T.pick(T.LAST_NAMES, F.floor(i / 8) % 8)),
        "other": F.concat(T.pick(T.FIRST_NAMES, (i + 3) % 8), F.lit(" "), T.pick(T.LAST_NAMES, i % 8)),
        "grade": (i % 15).cast("string"),
        "school": place,
        "tail": F.lpad((i % 1000).cast("string"), 3, "0"),
    }
    header = F.coalesce(*[F.when(i % len(LAYOUTS) == k, _filled(t, values)) for k, t in enumerate(LAYOUTS)])
    footer = F.coalesce(*[F.when(F.floor(i / 12) % 4 == k, F.lit(t)) for k, t in enumerate(FOOTERS)])
    whole = joined.select("doc_id", "source", F.col("text").alias("body"), F.concat(header, F.col("text"), footer).alias("text")).withColumn("lines", lines_of(X.trimmed(F.col("text"))))
    whole = whole.withColumn("all", solid(F.col("lines"))).withColumn("split", contact_split(F.col("lines")))
    return whole.withColumn("worded", solid(F.col("split.contact"))).withColumn("keys", folded_all(F.col("worded")))


def _pair():
    return F.col("worded"), F.col("keys")


def _three(f):
    return lambda s, d: forms(s, d).select("doc_id", f(F.col("all")).alias("h")).select("doc_id", "h.student_name", "h.school_name", "h.grade")


def _maps(s, d):
    i = F.col("doc_id")
    form = F.create_map(F.lit("Student Full Name"), F.when(i % 4 == 0, "Student Name").otherwise(F.concat(F.lit("Ann "), i.cast("string"))), F.lit("escuela"), F.when(i % 3 == 0, "").otherwise(F.col("source")), F.lit("Grado/Grade"), (i % 13).cast("string"))
    return T.read(s, d, "documents").select("doc_id", form.alias("form"))


def _paged(s, d):
    say = F.when((F.col("doc_id") + F.col("page_index")) % 3 == 0, F.concat(F.lit("Student's Name: Page"), F.col("page_index").cast("string"), F.lit("\nGrade: "), (F.col("page_index") % 9 + 1).cast("string"), F.lit("\n"))).otherwise("")
    return T.pages(s, d).withColumn("text", F.concat(say, "text"))


def _contact(s, d):
    joined = lambda c: X.trimmed(F.array_join(c, "\n"))
    return forms(s, d).select("doc_id", F.length(joined(F.col("split.contact"))).alias("contact_chars"), F.length(strip_footer(F.col("split.essay"))).alias("essay_chars"))


def _best(s, d):
    """The essay of each form: as the split finds it, as extracted (even ids have such a text), or the whole form as a last resort."""
    sources = forms(s, d).select("doc_id", strip_footer(F.col("split.essay")).alias("a"), F.when(F.col("doc_id") % 2 == 0, F.col("body")).alias("b"), X.trimmed(F.col("text")).alias("c"))
    text, label = X.best_text(("a", F.col("a")), ("b", F.col("b")), last=("c", F.col("c")))
    return sources.select("doc_id", F.length(text).alias("n"), label.alias("source"))


def _predicates(s, d):
    rows = forms(s, d).select("doc_id", F.posexplode("all").alias("line_no", "line"))
    tests = {"name": P.plausible_name, "fragment": P.fragment, "label": P.label_line, "value": P.candidate, "low_name": P.low_name, "low_school": P.low_school, "school": P.plausible_school}
    return rows.select("doc_id", "line_no", *[f(F.col("line")).alias(k) for k, f in tests.items()])


QUERIES = {
    "label_value": lambda s, d: forms(s, d).select("doc_id", near_label(*_pair(), ALIASES["student_name"]).alias("value"), near_label(*_pair(), ALIASES["school_name"], 80, True, False, 2).alias("same_line")),
    "fields_rules": lambda s, d: forms(s, d).select("doc_id", *[v.alias(k) for k, v in fields_rules(*_pair()).items()]),
    "header_regex": lambda s, d: forms(s, d).select("doc_id", *[v.alias(k) for k, v in header_regex(F.col("text")).items()]),
    "freeform_header": _three(freeform_header),
    "unlabeled_header": _three(unlabeled_header),
    "grade_near_anchor": lambda s, d: forms(s, d).select("doc_id", near_anchor(*_pair()).alias("grade")),
    "grade_wide": lambda s, d: forms(s, d).select("doc_id", grade_wide(F.col("lines")).alias("grade")),
    "strip_footer": lambda s, d: forms(s, d).select("doc_id", strip_footer(F.col("lines")).alias("essay")),
    "contact_essay_split": _contact,
    "best_text": _best,
    "contact_fallbacks": lambda s, d: forms(s, d).select("doc_id", *[v.alias(k) for k, v in contact_fallbacks(F.col("split.contact")).items()]),
    "fallback_record": lambda s, d: fallback_record(forms(s, d)),
    "form_map_fields": lambda s, d: form_map_fields(_maps(s, d)),
    "start_page_guard": lambda s, d: start_page_guard(_paged(s, d)),
    "plausible_preds": _predicates,
}

_W = X.SPACE
_TRIM = "regexp_replace({}, '^" + _W + "+|" + _W + "+$', '', 'g')"
_LIST = lambda values: "[" + ", ".join(P.quote(v) for v in values) + "]"


def _sql_filled(template: str) -> str:
    names = {"name": "nm", "other": "ot", "grade": "gr", "school": "sc", "tail": "tl"}
    pieces = [p for p in template.replace("}", "{").split("{") if p]
    return " || ".join([names.get(p, P.quote(p)) for p in pieces] or ["''"])


# Where contact lines end, by windows over numbered lines: independent of the fold.
SPLIT = f"""
sp_1 as (select doc_id, len(lines) as total, unnest(range(0, least(len(lines), 50))) as i0, unnest(lines[1:50]) as x from fm_2),
sp_2 as (select *, {P.sql_folded("x")} as k from sp_1),
sp_3 as (select *, case when x = '' then 'blank' when {P.sql_any("k", V.PROMPT_MARKS)} then 'prompt' when {P.sql_any("k", V.ESSAY_MARKS)} then 'mark'
  when {P.sql_any("k", V.CONTACT_STRICT)} or (length(x) <= 80 and {P.sql_any("k", V.CONTACT_LOOSE)}) then 'contact' when length(x) > 40 then 'long' else 'short' end as kind from sp_2),
sp_4 as (select *, coalesce(bool_or(kind = 'prompt') over w, false) as prompt, coalesce(bool_or(kind = 'mark') over w, false) as mark, i0 - coalesce(max(case when kind <> 'long' then i0 end) over w, -1) as run
  from sp_3 window w as (partition by doc_id order by i0 rows between unbounded preceding and 1 preceding)),
sp_5 as (select *, case when kind in ('long', 'short') and prompt and length(x) > 30 then 'now' when kind = 'long' and mark and run >= 2 then 'back' when kind = 'long' and i0 > 30 and run >= 3 then 'back2' end as stop from sp_4),
sp_6 as (select *, min(case when stop is not null then i0 end) over (partition by doc_id) as halt from sp_5),
sp_7 as (select doc_id, any_value(total) as total, greatest(3, coalesce(max(case when kind in ('prompt', 'mark', 'contact', 'short') and (halt is null or i0 < halt) then i0 + 1 end), 0)) as reached, any_value(halt) as halt, max(case when i0 = halt then stop end) as stop from sp_6 group by 1),
sp_8 as (select doc_id, case when total <= 3 then total else greatest(6, case stop when 'now' then halt when 'back' then greatest(reached, halt - 1) when 'back2' then halt - 2 else reached end) end as pos from sp_7)"""

FORMS = f"""
fm_0 as (select doc_id, source, text, coalesce(upper(n_name[1]) || lower(n_name[2:]), 'Hill') as sc, ({_LIST(T.FIRST_NAMES)})[doc_id % 8 + 1] || ' ' || ({_LIST(T.LAST_NAMES)})[doc_id // 8 % 8 + 1] as nm,
  ({_LIST(T.FIRST_NAMES)})[(doc_id + 3) % 8 + 1] || ' ' || ({_LIST(T.LAST_NAMES)})[doc_id % 8 + 1] as ot, (doc_id % 15)::varchar as gr, lpad((doc_id % 1000)::varchar, 3, '0') as tl
  from documents left join customer on c_custkey = doc_id left join nation on n_nationkey = c_nationkey),
fm_1 as (select doc_id, source, case doc_id % {len(LAYOUTS)} {" ".join(f"when {k} then {_sql_filled(t)}" for k, t in enumerate(LAYOUTS))} end || text ||
  case doc_id // 12 % 4 {" ".join(f"when {k} then {P.quote(t)}" for k, t in enumerate(FOOTERS))} end as text from fm_0),
fm_2 as (select *, list_transform(string_split({_TRIM.format("text")}, chr(10)), lambda x: {_TRIM.format("x")}) as lines from fm_1),
{SPLIT},
fm_3 as (select fm_2.*, list_filter(lines, lambda x: x <> '') as alls, lines[1:pos] as contact, lines[pos + 1:] as essay, list_filter(lines[1:pos], lambda x: x <> '') as worded from fm_2 join sp_8 using (doc_id)),
fm as (select *, list_transform(worded, lambda x: {P.sql_folded("x")}) as keys from fm_3)
"""
# The same by rows of documents, whose ids may repeat, with the text they were made from.
ROW_FORMS = FORMS.replace(SPLIT, SPLIT.replace("doc_id", "row_no")).replace("join sp_8 using (doc_id)", "join sp_8 using (row_no)").replace("(select doc_id, source, ", "(select row_no, body, doc_id, source, ")
ROW_FORMS = ROW_FORMS.replace("from documents left join", "from (select *, row_number() over () as row_no, text as body from documents) left join")
some, sql_let = P.sql_some, P.sql_let


def sql_first_place(lines: str, test) -> str:
    """1-based, null if there is none."""
    name = f"p{next(P._numbers)}"
    return f"nullif(list_position(list_transform({lines}, lambda {name}: coalesce({test(name)}, false)), true), 0)"


def sql_first(items: str) -> str:
    return f"list_filter({items}, lambda f9: f9 is not null)[1]"


def sql_each(items: str, use) -> str:
    name = f"e{next(P._numbers)}"
    return f"list_transform({items}, lambda {name}: {use(name)})"


def sql_where(items: str, test) -> str:
    name = f"w{next(P._numbers)}"
    return f"list_filter({items}, lambda {name}: {test(name)})"


def sql_colon(line: str) -> str:
    return P.sql_trim(f"regexp_extract({line}, ':((?s:.*))$', 1)")


def _sql_rest(line: str, alias: str) -> str:
    return P.sql_trim(f"regexp_replace({P.sql_trim(f'substr({line}, strpos(lower({line}), {alias}) + length({alias}))')}, '^[:/\\-]+', '')")


def sql_near(lines: str, keys: str, aliases: tuple[str, ...], most: int = 60, same_line: bool = False, after_only: bool = False, start: int = 0) -> str:
    """near_label() as SQL."""
    if start:
        lines, keys = f"{lines}[{start + 1}:]", f"{keys}[{start + 1}:]"
    pairs = "[" + ", ".join(f"{{'key': {P.quote(folded_text(a))}, 'raw': {P.quote(a)}}}" for a in aliases) + "]"
    good = lambda v, n: f"({P.sql_candidate(v, n)} and not {P.sql_father(v)})"

    def cut(s: str) -> str:
        ends = lambda w: f"regexp_replace(lower({w}), '[.,:;]+$', '') in ('grado', 'grade', 'escuela', 'school')"
        part = f"regexp_replace({s}, '/(?s:.*)$', '')"
        return sql_let(P.sql_words(part), lambda w: f"array_to_string({w}[1:coalesce({sql_first_place(w, ends)} - 1, len({w}))], ' ')")

    def tried(h: str, a: str) -> str:
        line, key = f"{h}.line", f"{h}.key"
        second = lambda s: sql_let(f"list_filter({pairs}, lambda q9: q9.raw <> {a}.raw and contains(lower({s}), q9.raw))[1].raw", lambda o: f"case when {o} is not null then {_sql_rest(s, o)} else {s} end")
        after = f"case when contains(lower({line}), {a}.raw) then {sql_let(sql_let(_sql_rest(line, f'{a}.raw'), second), cut)} end"
        left = P.sql_trim(f"regexp_replace({P.sql_trim(f'substr({key}, 1, strpos({key}, {a}.key) - 1) || substr({key}, strpos({key}, {a}.key) + length({a}.key))')}, '^[:/\\-]+', '')")
        variants = f"list_transform(list_filter({pairs}, lambda q9: contains({key}, q9.key) and contains(lower({line}), q9.raw)), lambda r9: {_sql_rest(line, 'r9.raw')})"
        around = [] if same_line else ([] if after_only else ["b1", "b2"]) + ["a1", "a2"]
        elsewhere = "coalesce(" + ", ".join([f"case when {P.sql_candidate(f'{h}.{k}', most)} then {h}.{k} end" for k in around] + ["null"]) + ")"
        other = sql_let(left, lambda v: f"case when {P.sql_candidate(v, most)} then coalesce({sql_where(variants, lambda x: good(x, most))}[1], case when not {P.sql_father(v)} then {v} end) else {elsewhere} end")
        own = sql_let(after, lambda v: f"case when {good(v, most)} then {v} else {other} end")
        return sql_let(sql_colon(line), lambda v: f"case when {good(v, 60)} then {v} else {own} end")

    def hit(p: str) -> str:
        at = lambda k: f"case when {p} + {k} > 0 then {lines}[{p} + {k}] end"
        return f"case when {p} is not null then {{'line': {lines}[{p}], 'key': {keys}[{p}], 'b1': {at(-1)}, 'b2': {at(-2)}, 'a1': {at(1)}, 'a2': {at(2)}}} end"

    place = sql_first_place(keys, lambda k: P.sql_any(k, tuple(map(folded_text, aliases))))
    return sql_let(sql_let(place, hit), lambda h: f"case when {h} is not null then {sql_let(f'list_filter({pairs}, lambda q9: contains({h}.key, q9.key))[1]', lambda a: tried(h, a))} end")


def sql_anchor(lines: str, keys: str, reach: int = 3) -> str:
    """near_anchor() as SQL."""
    places = f"list_filter(range(1, len({keys}) + 1), lambda i9: {P.sql_any(f'{keys}[i9]', ('grade', 'grado'))})"
    return sql_first(sql_each(places, lambda i: sql_first(sql_each(f"range(greatest({i} - {reach}, 1), least({i} + {reach}, len({lines})) + 1)", lambda j: P.sql_grade(f"{lines}[{j}]")))))


def _sql_by_colon(words: tuple[str, ...]) -> str:
    return sql_first(sql_each("range(1, len(keys) + 1)", lambda i: f"case when {P.sql_any(f'keys[{i}]', words)} then {sql_let(sql_colon(f'worded[{i}]'), lambda c: f'case when {P.sql_candidate(c)} then {c} end')} end"))


def _near(field: str, most: int = 60, **flags) -> str:
    return sql_near("worded", "keys", ALIASES[field], most, **flags)


_RULES = {
    "student_name": _near("student_name", after_only=True),
    "school_name": _near("school_name", after_only=True),
    "grade": f"coalesce({sql_let(_near('grade', 30, after_only=True), P.sql_grade)}, {sql_anchor('worded', 'keys')})",
    "teacher_name": _sql_by_colon(("teacher", "maestro")),
    "city_or_location": _sql_by_colon(("city", "location", "ciudad")),
    "father_figure_name": _near("father_figure_name", 80, after_only=True),
    "phone": _near("phone", 30, after_only=True),
    "email": _near("email", 80, after_only=True),
}
_HEAD = {
    "student_name": r"(?i)student''?s? name *: *([^\n]{2,60})",
    "grade": r"(?i)(?:grade|grado) *:? *(1[0-2]|[1-9]|k)\b",
    "school_name": r"(?i)(?:school|escuela) *: *([^\n]{3,80})",
}


def _head(field, c="text"):
    return f"nullif({_TRIM.format(f'regexp_extract({c}, {chr(39)}{_HEAD[field]}{chr(39)}, 1)')}, '')"


def sql_freeform(lines: str, n: int = 12) -> str:
    """freeform_header() as SQL: a struct."""
    part = lambda line, g: f"regexp_extract({line}, '{SCHOOL_GRADE}', {g})"

    def region(top: str) -> str:
        def fit(i: str) -> str:
            name, line = f"t[{i}]", f"t[{i} + 1]"
            return (
                f"case when regexp_matches({line}, '{SCHOOL_GRADE}') then try_cast({part(line, 2)} as int) between 1 and 12 and length({name}) <= 40 and {P.sql_name(name)} "
                f"and not {P.sql_in(f'lower({name})', V.NAME_LABELS + ('school', 'grade'))} and {P.sql_candidate(P.sql_trim(part(line, 1)), 120)} else false end"
            )

        place = f"list_filter(range(1, len(t)), lambda i9: {fit('i9')})[1]"
        found = sql_let(place, lambda i: f"case when {i} is not null then {{'student_name': t[{i}], 'school_name': {P.sql_trim(part(f't[{i} + 1]', 1))}, 'grade': ({part(f't[{i} + 1]', 2)}::int)::varchar}} end")
        return f"list_transform([{top}], lambda t: {found})[1]"

    return f"coalesce({region(f'{lines}[1:{n}]')}, case when len({lines}) > {n} then {region(f'{lines}[-{n}:]')} end)"


def sql_unlabeled(lines: str, n: int = 8) -> str:
    """unlabeled_header() as SQL: a struct."""
    words = ("student", "grade", "school", "escuela", "name", "nombre", "essay", "father")
    pattern = r"(?i)^(?:name|nombre)[ ]*[:\-][ ]*(.+)$"
    named = lambda x: sql_let(P.sql_trim(f"regexp_extract({x}, '{pattern}', 1)"), lambda v: f"case when {v} <> '' and length({v}) <= 40 and not contains(lower({x}), 'father') and {P.sql_name(v)} then {v} end")
    plain = lambda x: f"length({x}) <= 40 and not {P.sql_any(f'lower({x})', words)} and not {P.sql_fragment(x)} and {P.sql_name(x)} and {P.sql_candidate(x, 40)}"
    school = lambda x: f"length({x}) between 4 and 120 and {P.sql_any(f'lower({x})', V.HEADER_SCHOOLS)} and lower({x}) not in ('school', 'escuela', 'school name') and {P.sql_candidate(x, 120)} and not {P.sql_fragment(x)}"
    grade = lambda t: f"nullif(regexp_extract(coalesce({sql_where(t, lambda x: f'''regexp_matches({x}, '{GRADE_LINE}')''')}[1], ''), '{GRADE_LINE}', 1), '')"
    return sql_let(f"{lines}[1:{n}]", lambda t: f"{{'student_name': coalesce({sql_first(sql_each(t, named))}, {sql_where(t, plain)}[1]), 'school_name': {sql_where(t, school)}[1], 'grade': {grade(t)}}}")


def sql_footer(lines: str) -> str:
    def body(ls: str) -> str:
        cut = f"list_max(list_transform(range(1, len({ls}) + 1), lambda i9: case when {P.sql_any(f'lower({ls}[i9])', REACTION)} then i9 end))"
        return sql_let(cut, lambda c: f"case when {c} is null then {ls} else {ls}[1:{c} - 1] end")

    def peeled(b: str) -> str:
        keep = f"list_max(list_transform(range(1, len({b}) + 1), lambda i9: case when {b}[i9] <> '' and not {P.sql_any(f'lower({b}[i9])', FOOTER)} and not (length({b}[i9]) <= 3 and not regexp_matches({b}[i9], '^[A-Za-z]')) then i9 end))"
        return P.sql_trim(f"array_to_string({b}[1:coalesce({keep}, 0)], chr(10))")

    return sql_let(sql_let(lines, body), peeled)


def _sql_found(c: str, p: str) -> str:
    return f"nullif(regexp_extract(coalesce({c}, ''), '{p}', 1), '')"


def sql_contacts(lines: str) -> dict[str, str]:
    """contact_fallbacks() as SQL."""
    each = f"range(1, len({lines}) + 1)"
    at = lambda i, k=0: f"{lines}[{i} + {k}]"

    def labelled(words, own, after) -> str:
        return sql_first(sql_each(each, lambda i: f"case when {P.sql_any(f'lower({at(i)})', words)} then coalesce({own(at(i))}, {after(at(i, 1))}, {after(at(i, 2))}) end"))

    number = lambda x: sql_let(f"regexp_replace({_sql_found(x, '(?i)(?:phone|tel[eé]fono|tel)[: ]+([0-9 ' + chr(92) + '-().]+)')}, '[^0-9\\-().]', '', 'g')", lambda v: f"case when length(regexp_replace({v}, '[^0-9]', '', 'g')) >= 10 then {v} end")
    clean = lambda x: f"array_to_string({P.sql_words(f'''regexp_replace({x}, '[^{chr(92)}pL{chr(92)}pN_ {chr(92)}-&]', '', 'g')''')}, ' ')"
    school = lambda x: f"case when length({x}) >= 3 then coalesce({sql_let(clean(x), lambda c: f'''case when regexp_matches({x}, '{SCHOOL_WORD}') and length({c}) > 3 then {c} end''')}, case when regexp_full_match({x}, '[A-Z][a-z]+(?: +[A-Z][a-z]+){{1,4}}') then {x} end) end"
    around = lambda i: sql_first(sql_each(f"list_filter(range(greatest({i} - 3, 1), least({i} + 3, len({lines})) + 1), lambda j9: j9 <> {i})", lambda j: school(at(j))))
    near = sql_first(sql_each(each, lambda i: f"case when {P.sql_any(f'lower({at(i)})', ('school', 'escuela'))} then {around(i)} end"))
    wide = sql_first(sql_each(lines, lambda x: f"case when length({x}) >= 5 and regexp_matches({x}, '{SCHOOL_WORD}') then {sql_let(clean(x), lambda c: f'''case when (length({c}) > 8 and not contains(lower({c}), 'school')) or len({P.sql_words(c)}) > 1 then {c} end''')} end"))
    return {
        "phone": labelled(("phone", "teléfono", "telefono", "tel"), number, lambda y: "coalesce(" + ", ".join(_sql_found(y, p) for p in PHONE) + ")"),
        "email": labelled(("email", "correo", "e-mail"), lambda x: _sql_found(x, "(?i)(?:email|correo|e-mail)[: ]+" + MAIL), lambda y: _sql_found(y, MAIL)),
        "school_name": f"coalesce({near}, {wide})",
    }


_SQL_TESTS = {"name": P.sql_name, "fragment": P.sql_fragment, "label": P.sql_label_line, "value": P.sql_candidate, "low_name": P.sql_low_name, "low_school": P.sql_low_school, "school": P.sql_school}
_ANCHOR = rf"gl as (select doc_id, lines, {sql_first_place('lines', lambda x: f'''regexp_matches(lower({x}), '{chr(92)}b(?:grade|grado){chr(92)}b')''')} as pos from fm)"
ORACLE = {
    "label_value": T.sql(f"select doc_id, {_near('student_name')} as value, {sql_near('worded', 'keys', ALIASES['school_name'], 80, True, False, 2)} as same_line from fm", FORMS),
    "fields_rules": T.sql("select doc_id, {} from fm".format(", ".join(f"{v} as {k}" for k, v in _RULES.items())), FORMS),
    "header_regex": T.sql("select doc_id, {} from fm".format(", ".join(f"{_head(k)} as {k}" for k in _HEAD)), FORMS),
    "freeform_header": T.sql(f"h as (select doc_id, {sql_freeform('alls')} as h from fm) select doc_id, h.student_name, h.school_name, h.grade from h", FORMS),
    "unlabeled_header": T.sql(f"h as (select doc_id, {sql_unlabeled('alls')} as h from fm) select doc_id, h.student_name, h.school_name, h.grade from h", FORMS),
    "grade_near_anchor": T.sql(f"select doc_id, {sql_anchor('worded', 'keys')} as grade from fm", FORMS),
    "grade_wide": T.sql(r"""select doc_id, coalesce(nullif(regexp_extract(lines[pos], '\b(1[0-2]|[1-9])(?:st|nd|rd|th)?\b', 1), ''),
      nullif(regexp_extract(list_filter(case when pos is not null then lines[pos + 1:pos + 10] end, lambda x: regexp_full_match(x, '(?:1[0-2]|[1-9])(?:st|nd|rd|th)?') and not regexp_matches(lower(x), 'contest|deadline|date'))[1], '^(1[0-2]|[1-9])', 1), '')) as grade from gl""", FORMS, _ANCHOR),
    "strip_footer": T.sql(f"select doc_id, {sql_footer('lines')} as essay from fm", FORMS),
    "contact_essay_split": T.sql(f"select doc_id, length({P.sql_trim('array_to_string(contact, chr(10))')})::int as contact_chars, length({sql_footer('essay')})::int as essay_chars from fm", FORMS),
    "best_text": T.sql(rf"""t as (select d.doc_id, {sql_footer('essay')} as a, case when d.doc_id % 2 = 0 then d.body end as b, {P.sql_trim('d.text')} as c from fm_2 d left join fm_3 using (row_no)),
      u as (select *, {", ".join(rf"coalesce(len(regexp_extract_all({x}, '[^\x09-\x0D\x20]+')), 0) as n{x}" for x in "abc")} from t),
      v as (select *, case when na >= 30 then 'a' when nb >= 30 then 'b' when na > 0 then 'a' when nb > 0 then 'b' when nc > 0 then 'c' else 'none' end as source from u)
      select doc_id, (case source when 'a' then length(a) when 'b' then length(b) when 'c' then length(c) else 0 end)::int as n, source from v""", ROW_FORMS),
    "contact_fallbacks": T.sql("select doc_id, {} from fm".format(", ".join(f"{v} as {k}" for k, v in sql_contacts("contact").items())), FORMS),
    "fallback_record": T.sql(f"t as (select *, length(regexp_replace(text, '{_W}+', '', 'g')) as n from fm) select doc_id, n < 50 as is_blank, concat_ws(',', case when n < 50 then 'template_blank' end, case when contains(lower(text), 'student') then 'has_label' end, 'fallback') as notes from t", FORMS),
    "form_map_fields": "select doc_id, case when doc_id % 4 <> 0 then 'Ann ' || doc_id end as student_name, case when doc_id % 3 <> 0 then source end as school_name, (doc_id % 13)::varchar as grade from documents",
    "start_page_guard": T.sql("""p as (select doc_id, page_index, case when (doc_id + page_index) % 3 = 0 then 'Student''s Name: Page' || page_index || chr(10) || 'Grade: ' || (page_index % 9 + 1) || chr(10) else '' end || text as text from doc_pages),
      f as (select doc_id, page_index, {n} as n, {g} as g, page_index = min(page_index) over (partition by doc_id) as st from p),
      a as (select doc_id, max(n) filter (st) as student_name, max(g) filter (st) as grade, max(n) filter (not st) as n2, max(g) filter (not st) as g2 from f group by 1)
      select doc_id, student_name, grade, concat_ws(',', case when student_name is null and n2 is not null then 'student_name' end, case when grade is null and g2 is not null then 'grade' end) as risk from a""".format(n=_head("student_name"), g=_head("grade")), T.PAGES),
    "plausible_preds": T.sql("l as (select doc_id, unnest(range(0, len(alls)))::int as line_no, unnest(alls) as line from fm) select doc_id, line_no, {} from l".format(", ".join(f"{f('line')} as {k}" for k, f in _SQL_TESTS.items())), FORMS),
}
