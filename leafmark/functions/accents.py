"""Letters without accents: canonical decomposition for all of Unicode, in the JVM.

What a character becomes without its marks is a rule of Unicode, so the table is made from Python's copy of it once a process: characters that become
one other go through `translate`, marks are deleted by it, and the few that become several (Korean syllables by their arithmetic, some
two-part vowels) are mapped one by one in texts that hold any.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No character beyond the first range decomposes; the second holds further marks.
RANGES = ((0x80, 0x30000), (0xE0100, 0xE01F0))
#: Korean syllables: the first, how many there are, and the first letters of the three kinds with how many of the latter two.
SYLLABLES, N_SYLLABLES = 0xAC00, 11172
LEADS, VOWELS, TAILS, N_VOWELS, N_TAILS = 0x1100, 0x1161, 0x11A7, 21, 28
QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"'}


def unmarked(text: str) -> str:
    """text in canonical decomposition without its non-spacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """Characters to translate, what they become (marks, at the end of the former, have no counterpart), and those that become several."""
    single, marks, several = [], [], {}
    for low, high in RANGES:
        for point in range(low, high):
            if 0xD800 <= point < 0xE000 or SYLLABLES <= point < SYLLABLES + N_SYLLABLES:
                continue
            char = chr(point)
            plain = unmarked(char)
            if not plain:
                marks.append(char)
            elif len(plain) > 1:
                several[char] = plain
            elif plain != char:
                single.append((char, plain))
    return "".join(c for c, _ in single) + "".join(marks), "".join(p for _, p in single), several


def simple(text: str) -> str:
    """What accentless() does to a text, for literals that are compared with its results."""
    out, into, _ = tables()
    return text.lower().translate(str.maketrans(out[: len(into)], into, out[len(into) :])).translate(str.maketrans(QUOTES))


def accentless(c: Column) -> Column:
    """Lower case without accents, with straight quotes; characters that decompose into several letters stay whole."""
    out, into, _ = tables()
    quotes, straight = "".join(QUOTES), "".join(QUOTES.values())
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(c), quotes + out, straight + into)).otherwise(F.lower(c))


def _letter(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def plain(c: Column) -> Column:
    """Lower case in canonical decomposition without marks, with straight quotes."""
    several = tables()[2]
    last = chr(SYLLABLES + N_SYLLABLES - 1)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def parts(char: Column) -> Column:
        at = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long") - SYLLABLES
        tail = at % N_TAILS
        syllable = F.concat(
            _letter(F.lit(LEADS) + F.floor(at / (N_VOWELS * N_TAILS))), _letter(F.lit(VOWELS) + F.floor(at % (N_VOWELS * N_TAILS) / N_TAILS)), F.when(tail > 0, _letter(F.lit(TAILS) + tail)).otherwise("")
        )
        return F.when(char.between(chr(SYLLABLES), last), syllable).otherwise(F.coalesce(F.element_at(table, char), char))

    one = accentless(c)
    whole = F.array_join(F.transform(F.split(one, ""), parts), "")
    return F.when(c.rlike(f"[{chr(SYLLABLES)}-{last}{''.join(several)}]"), whole).otherwise(one)
