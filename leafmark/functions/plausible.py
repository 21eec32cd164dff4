"""Whether a piece of text can be a name, a school or a value, and canonical school names.

Every test is one expression over a line of text. A value that an expression needs more than once is
bound by text.let(), so that expressions stay small however they are composed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import accents
from leafmark.functions import fixed as V
from leafmark.functions import text as X
from leafmark.functions.text import let


def folded(c: Column) -> Column:
    """A trimmed text for matching: lower case, no accents, straight quotes, single blanks."""
    return accents.accentless(F.regexp_replace(c, r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " "))


_S, _N = X.SPACE, r"[^\x09-\x0D\x20]"
_OPEN, _SHUT = f"(?<!{_N})", f"(?!{_N})"


def _literal(part: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", part)


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether any part occurs; parts that hold another part are not looked for. Few are searched one by one, many by one pattern."""
    least = [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]
    return reduce(lambda a, b: a | b, [c.contains(p) for p in least]) if len(least) < 30 else c.rlike("|".join(map(_literal, least)))


def starts_any(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike(f"^(?:{'|'.join(map(_literal, parts))})")


def fragment(c: Column) -> Column:
    """The beginning of a sentence rather than a value."""
    return starts_any(F.lower(X.trimmed(c)), V.FRAGMENT_STARTS)


_LABELS = "|".join(V.LABEL_WORDS)
_ALPHA = rf"{_OPEN}[A-Za-z'\-]+{_SHUT}"
_PROPER = rf"{_OPEN}(?!(?i:{_LABELS}){_SHUT})[A-Za-z'\-]{{4,}}{_SHUT}"
_LABEL = f"{_OPEN}(?:{_LABELS}){_SHUT}"
_OTHER = f"{_OPEN}(?!(?:{_LABELS}|:|/|:/){_SHUT}){_N}+"


def _is_label(s: Column, key: Column) -> Column:
    proper = s.rlike(_PROPER) & F.regexp_count(s, F.lit(_ALPHA)).between(2, 8)
    labelled = key.rlike(_LABEL) & (F.regexp_count(key, F.lit(_OTHER)) <= 1)
    return (F.length(key) < 2) | (~proper & (labelled | has_any(key, V.LABEL_PHRASES)))


def _with_key(c: Column) -> Column:
    s = X.trimmed(c)
    return F.struct(s.alias("s"), folded(s).alias("key"))


def label_line(c: Column) -> Column:
    """A label without a value, or other text of the form itself."""
    return let(_with_key(c), lambda v: _is_label(v["s"], v["key"]))


def _is_candidate(s: Column, key: Column, most: Column | int) -> Column:
    enough = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")) >= F.length(s) * 0.4
    return F.coalesce((F.length(s) >= 1) & (F.length(s) <= most) & ((F.length(s) > 1) | s.rlike(r"^\d$")) & enough & ~_is_label(s, key), F.lit(False))


def candidate(c: Column, most: int = 60) -> Column:
    """A usable value: not too long, 40 % letters and digits at least, no label."""
    return let(_with_key(c), lambda v: _is_candidate(v["s"], v["key"], most))


def judged(values: list[tuple[Column, int]], more: Column, most: int) -> Column:
    """An array with, for each value and its greatest length, then for more values of one length: the value if it is usable (ok), and if it also speaks of no father (good)."""

    def judge(v: Column) -> Column:
        usable = _is_candidate(v["s"], v["key"], v["most"])
        return F.struct(F.when(usable, v["raw"]).alias("ok"), F.when(usable & ~has_any(v["key"], V.FATHER), v["raw"]).alias("good"))

    entry = lambda v, n: F.struct(v.alias("raw"), F.lit(n).alias("most"))
    given = F.concat(F.array(*[entry(v, n) for v, n in values]), F.transform(more, lambda v: entry(v, most)))
    keyed = F.transform(given, lambda x: F.struct(x["raw"].alias("raw"), x["most"].alias("most"), X.trimmed(x["raw"]).alias("s"), folded(X.trimmed(x["raw"])).alias("key")))
    return F.transform(keyed, judge)


def father(c: Column) -> Column:
    return has_any(folded(X.trimmed(c)), V.FATHER)


def plausible_name(c: Column, most: int = 40) -> Column:
    """Two to four words without digits, dates or words that no name holds; capitals somewhere, or letters only."""

    def judge(v: Column) -> Column:
        s, key = v["s"], v["key"]
        dated = has_any(key, V.WEEKDAYS) & (has_any(key, V.MONTHS) | s.contains(","))
        shaped = s.rlike(rf"{_OPEN}\p{{Lu}}") | s.rlike(r"^[\p{L}\x09-\x0D\x20]+$")
        odd = s.rlike(f"(?i){_OPEN}(?:{'|'.join(V.NAME_REJECTS)}){_SHUT}")
        return F.coalesce((F.length(s) <= most) & s.rlike(f"^{_N}+(?:{_S}+{_N}+){{1,3}}$") & ~s.rlike(r"\p{Nd}") & shaped & ~odd & ~dated, F.lit(False))

    return let(_with_key(F.regexp_replace(X.trimmed(c), r"^[^A-Za-z]+", "")), judge)


def low_name(c: Column) -> Column:
    """Missing, fewer than four letters, or two tokens of one or two characters."""
    s = X.trimmed(F.coalesce(c, F.lit("")))
    return (F.length(F.regexp_replace(s, r"[^A-Za-z]+", "")) < 4) | s.rlike(f"^{_N}{{1,2}}{_S}+{_N}{{1,2}}$")


def low_school(c: Column) -> Column:
    """Missing, form text, too long, hardly any letters, or a number with a letter."""
    s = X.trimmed(F.coalesce(c, F.lit("")))
    return has_any(F.lower(s), V.LOW_SCHOOL) | (F.length(s) > 40) | (F.length(F.regexp_replace(s, r"[^\p{L}]+", "")) < 2) | s.rlike(r"^#? *\d{1,4} *[A-Za-z]?$")


def plausible_school(c: Column) -> Column:
    """Not of low quality, at most five words, and with a school word, a school number, or capitals throughout."""
    s = X.trimmed(F.coalesce(c, F.lit("")))
    titled = s.rlike(f"^{_N}+(?:{_S}+{_N}+){{1,3}}$") & ~s.rlike(rf"{_OPEN}(?!\p{{Lu}})\p{{L}}")
    return ~low_school(c) & ~s.rlike(f"(?:{_N}+{_S}+){{5}}{_N}") & (has_any(F.lower(s), V.SCHOOL_SIGNS) | s.rlike(r"(?i)^(?:p\.? *s\.? *)?\d{1,4} *[a-z]?$") | titled)


def name_from_file(c: Column) -> Column:
    """A plausible name among the first three worded parts of a file's stem; none for blank templates."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")
    template = starts_any(F.lower(F.regexp_replace(stem, r"[\x09-\x0D\x20()]", "")), V.FILE_TEMPLATES)
    bare = lambda w: F.regexp_replace(w, "['’‘]", "")
    usable = lambda w: bare(w).rlike(r"^\p{L}{2,25}$") & ~F.lower(w).isin(*V.FILE_STOPS)
    parts = F.slice(F.filter(F.split(stem, r"[-_\x09-\x0D\x20]+"), usable), 1, 3)
    return let(parts, lambda p: F.when((F.size(p) >= 2) & ~template & plausible_name(F.array_join(p, " ")), F.array_join(p, " ")))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canon_name(c: Column) -> tuple[Column, Column]:
    """(shown, key) of a school: cleaned, corrected, looked up; unknown schools keep their cleaned name and have no key."""

    def find(shown: Column) -> Column:
        plain = F.array_join(X.words(F.regexp_replace(F.lower(shown), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")), " ")
        fixed = let(plain, lambda k: F.coalesce(_lookup(V.SCHOOL_TYPOS, k), k))
        return let(fixed, lambda k: F.struct(k.alias("plain"), _lookup(V.SCHOOL_KEYS, k).alias("key")))

    found = let(X.display_name(c), lambda s: F.when(s.isNotNull(), find(s)))
    titled = lambda k: F.array_join(F.transform(F.split(k, " "), lambda w: F.when(F.upper(w).isin(*X.ACRONYMS), F.upper(w)).otherwise(X.capitalized(w))), " ")
    return let(found, lambda v: F.coalesce(_lookup(V.SCHOOL_NAMES, v["key"]), titled(v["plain"]))), let(found, lambda v: v["key"])


# The same tests as SQL over an expression's text.

_numbers = iter(range(1 << 30))
_W = X.SPACE


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def sql_let(value: str, use: Callable[[str], str]) -> str:
    name = f"v{next(_numbers)}"
    return f"list_transform([{value}], lambda {name}: {use(name)})[1]"


def sql_some(items: str, test: Callable[[str], str]) -> str:
    name = f"v{next(_numbers)}"
    return f"(len(list_filter({items}, lambda {name}: coalesce({test(name)}, false))) > 0)"


def sql_any(c: str, parts: tuple[str, ...], test: str = "contains") -> str:
    return "(" + " or ".join(f"{test}({c}, {quote(p)})" for p in parts) + ")"


def sql_in(c: str, values) -> str:
    return f"{c} in ({', '.join(quote(v) for v in values)})"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_W}+'), lambda w9: w9 <> '')"


def sql_folded(c: str) -> str:
    return f"translate(lower(regexp_replace({sql_trim(c)}, '{_W}+', ' ', 'g')), {quote(X.ACCENTS_FROM)}, {quote(X.ACCENTS_TO)})"


def sql_fragment(c: str) -> str:
    return sql_let(f"lower({sql_trim(c)})", lambda s: sql_any(s, V.FRAGMENT_STARTS, "starts_with"))


def sql_label_line(c: str) -> str:
    def judge(v: str) -> str:
        alpha = f"list_filter({v}.words, lambda a9: regexp_full_match(a9, '[A-Za-z''\\-]+'))"
        proper = f"(len({alpha}) between 2 and 8 and {sql_some(alpha, lambda w: f'length({w}) >= 4 and not ' + sql_in(f'lower({w})', V.LABEL_WORDS))})"
        words = sql_words(f"{v}.key")
        others = f"len(list_filter({words}, lambda o9: not {sql_in('o9', V.LABEL_WORDS)} and o9 not in (':', '/', ':/')))"
        labelled = f"({sql_some(words, lambda w: sql_in(w, V.LABEL_WORDS))} and {others} <= 1)"
        return f"(length({v}.key) < 2 or (not {proper} and ({labelled} or {sql_any(f'{v}.key', V.LABEL_PHRASES)})))"

    return sql_let(f"{{'key': {sql_folded(c)}, 'words': {sql_words(c)}}}", judge)


def sql_candidate(c: str, most: int = 60) -> str:
    def judge(s: str) -> str:
        solid = f"length(regexp_replace({s}, '[^\\pL\\pN]+', '', 'g'))"
        return f"case when {s} = '' or (length({s}) = 1 and not regexp_full_match({s}, '[0-9]')) or length({s}) > {most} or {solid} < length({s}) * 0.4 then false else not {sql_label_line(s)} end"

    return f"coalesce({sql_let(sql_trim(c), judge)}, false)"


def sql_father(c: str) -> str:
    return sql_any(sql_folded(c), V.FATHER)


def sql_name(c: str, most: int = 40) -> str:
    def judge(v: str) -> str:
        dated = f"({sql_any(f'{v}.low', V.WEEKDAYS)} and ({sql_any(f'{v}.low', V.MONTHS)} or contains({v}.s, ',')))"
        tokens = f"{v}.tokens"
        capital = sql_some(tokens, lambda t: f"regexp_matches({t}, '^\\p{{Lu}}')")
        letters = f"not {sql_some(tokens, lambda t: f'''not regexp_full_match({t}, '{chr(92)}pL+')''')}"
        odd = sql_some(tokens, lambda t: sql_in(f"lower({t})", V.NAME_REJECTS))
        return f"({v}.s <> '' and length({v}.s) <= {most} and not regexp_matches({v}.s, '\\p{{Nd}}') and not {dated} and len({tokens}) between 2 and 4 and not {odd} and ({capital} or {letters}))"

    core = sql_trim(f"regexp_replace({sql_trim(c)}, '^[^A-Za-z]+', '')")
    return f"coalesce({sql_let(sql_let(core, lambda s: f'''{{'s': {s}, 'low': {sql_folded(s)}, 'tokens': {sql_words(s)}}}'''), judge)}, false)"


def sql_low_name(c: str) -> str:
    tokens = lambda v: sql_let(sql_words(v), lambda w: f"len({w}) = 2 and length({w}[1]) <= 2 and length({w}[2]) <= 2")
    return sql_let(sql_trim(f"coalesce({c}, '')"), lambda v: f"({v} = '' or length(regexp_replace({v}, '[^A-Za-z]+', '', 'g')) < 4 or {tokens(v)})")


def sql_low_school(c: str) -> str:
    return sql_let(sql_trim(f"coalesce({c}, '')"), lambda v: f"({v} = '' or {sql_any(f'lower({v})', V.LOW_SCHOOL)} or length({v}) > 40 or length(regexp_replace({v}, '[^\\pL]+', '', 'g')) < 2 or regexp_full_match({v}, '#? *[0-9]{{1,4}} *[A-Za-z]?'))")


def sql_school(c: str) -> str:
    def judge(v: str) -> str:
        titled = sql_let(sql_words(v), lambda w: f"(len({w}) between 2 and 4 and not {sql_some(w, lambda t: f'''regexp_matches({t}, '^{chr(92)}pL') and not regexp_matches({t}, '^{chr(92)}p{{Lu}}')''')})")
        numbered = f"regexp_full_match(lower({v}), '(?:p\\.? *s\\.? *)?[0-9]{{1,4}} *[a-z]?')"
        return f"(not {sql_low_school(v)} and len({sql_words(v)}) <= 5 and ({sql_any(f'lower({v})', V.SCHOOL_SIGNS)} or {numbered} or {titled}))"

    return sql_let(sql_trim(f"coalesce({c}, '')"), judge)


def sql_grade(c: str) -> str:
    """The grade near a label, as text.grade_parse()."""

    def judge(v: str) -> str:
        number = lambda p: f"nullif(regexp_extract({v}.s, '{p}', 1), '')"
        large = sql_some(f"regexp_extract_all({v}.s, '\\b(\\d{{2}})\\b', 1)", lambda x: f"{x}::int > 12")
        kinder = f"({sql_in(f'upper({v}.s)', V.KINDER)} or ({v}.n <= 2 and contains(upper({v}.s), 'K')) or regexp_matches({v}.s, '{V.KINDER_PATTERN}'))"
        single = f"coalesce({number('^([1-9]|1[0-2])$')}, {number('(?i)^([1-9]|1[0-2])(?:st|nd|rd|th)$')})"
        after = number(r"(?i)(?:grade|grado)[ ]*[:\-/]?[ ]*([1-9]|1[0-2])(?:st|nd|rd|th)?\b")
        before = number(r"(?i)\b([1-9]|1[0-2])(?:st|nd|rd|th)?[ ]*(?:grade|grado)\b")
        return f"case when {v}.n > 4 or regexp_matches({v}.s, '\\b(?:19|20)\\d{{2}}\\b') or {large} then null when {kinder} then 'K' when {v}.n = 1 then {single} else coalesce({after}, {before}) end"

    return sql_let(sql_let(sql_trim(c), lambda s: f"{{'s': {s}, 'n': len({sql_words(s)})}}"), judge)


def sql_name_from_file(c: str) -> str:
    stem = f"regexp_replace(regexp_extract({c}, '([^/]*)$', 1), '\\.[^.]*$', '')"
    template = sql_any(f"lower(regexp_replace({stem}, '[\\x09-\\x0D\\x20()]', '', 'g'))", V.FILE_TEMPLATES, "starts_with")
    parts = f"list_filter(regexp_split_to_array({stem}, '[-_\\x09-\\x0D\\x20]+'), lambda p9: regexp_full_match(regexp_replace(p9, '[''’‘]', '', 'g'), '\\pL{{2,25}}') and not {sql_in('lower(p9)', V.FILE_STOPS)})[1:3]"
    joined = lambda p: f"array_to_string({p}, ' ')"
    return sql_let(parts, lambda p: f"case when len({p}) >= 2 and not {template} and {sql_name(joined(p))} then {joined(p)} end")


def sql_map(table: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items()) + " end"
