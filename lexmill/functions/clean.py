"""Text cleaning as column expressions. Null stays null."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "<[^<>]+>"
#: Control and zero-width characters and the no-break space, each of which becomes a space.
ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{00A0}\x{00AD}\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]"
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
WIDE = r"[\x{3000}\x{FF01}-\x{FF5E}]"
#: Characters of which a run becomes one.
RUNS = " \t\n.,!?;:-_=*#~$%&。，！？；：、…"
PAIRS = ("()", "[]", "{}", "（）", "【】", "〔〕", "《》")
URL = r"""(?:https?|ftp)://[^\s<>"'()（），。！？；]+|www\.[A-Za-z0-9-]+\.[^\s<>"'()（），。！？；]+"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
#: Phone numbers between two characters that are no digits.
MOBILE = r"([^0-9])(?:\+?86[ -]?)?1[3-9][0-9]{9}([^0-9])"
LANDLINE = r"([^0-9])(?:\(?0[0-9]{2,3}\)?[ -]?[0-9]{7,8}|\+[0-9]{1,3}[ -]?(?:\(?[0-9]{2,4}\)?)?[ -]*[0-9]{3,4}[ -]?[0-9]{4})([^0-9])"
#: What any such number holds (a landline's is part of a mobile one).
MOBILE_DIGITS, LANDLINE_DIGITS = "1[3-9][0-9]{9}", r"[0-9]{7}|\+[0-9]"
SENTINEL = "￥"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&eacute;": "é", "&hellip;": "…", "&mdash;": "—", "&amp;": "&"}
ROUNDS = 4  # of bracket removal before the rest of the nesting is counted


def bound(c: Column, f) -> Column:
    """f(c) with c computed once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _where(c: Column, test, f) -> Column:
    """f(c) where test holds, which all texts pass that f would change; a cheap look spares most texts the costly step."""
    return bound(c, lambda t: F.when(test(t), f(t)).otherwise(t))


def strip_tags(c: Column) -> Column:
    return _where(c, lambda t: F.contains(t, F.lit("<")), lambda t: F.regexp_replace(t, TAG, ""))


def unescape_common(c: Column) -> Column:
    """The entities of ENTITIES, the ampersand last."""

    def replaced(t: Column) -> Column:
        for entity, char in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return _where(c, lambda t: F.contains(t, F.lit("&")), replaced)


def unescape(c: Column) -> Column:
    """All named and numeric references; the full table needs Python."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(html.unescape, na_action="ignore")

    return run(c)


def odd_to_space(c: Column) -> Column:
    return F.regexp_replace(c, ODD, " ")


def half_width(c: Column) -> Column:
    return _where(c, lambda t: t.rlike(WIDE), lambda t: F.translate(t, FULL, HALF))


def collapse_runs(c: Column, chars: str = RUNS) -> Column:
    listed = "".join(f"\\x{{{ord(x):04X}}}" for x in chars)
    return F.regexp_replace(c, f"([{listed}])\\1+", "$1")


def _pair(pair: str) -> str:
    a, b = (f"\\x{{{ord(x):04X}}}" for x in pair)
    return f"{a}[^{a}{b}]*{b}"


def _peel(c: Column, pairs: tuple[str, ...]) -> Column:
    for p in pairs:
        c = F.regexp_replace(c, _pair(p), "")
    return c


def remove_brackets(c: Column, pairs: tuple[str, ...] = PAIRS) -> Column:
    """Bracketed text goes from the inside out until nothing changes; texts without a left bracket are left alone.

    ROUNDS rounds do for most texts; one that still has a whole pair gets as many more as
    it has left brackets, which no nesting exceeds.
    """
    left = "[" + "".join(f"\\x{{{ord(p[0]):04X}}}" for p in pairs) + "]"
    more = lambda t: F.aggregate(F.sequence(F.lit(1), F.regexp_count(t, F.lit(left))), t, lambda a, _: _peel(a, pairs))

    def peeled(t: Column) -> Column:
        for _ in range(ROUNDS):
            t = _peel(t, pairs)
        return bound(t, lambda u: F.when(u.rlike("|".join(map(_pair, pairs))), more(u)).otherwise(u))

    return bound(c, lambda t: F.when(t.rlike(left), peeled(t)).otherwise(t))


def remove_urls(c: Column) -> Column:
    return _where(c, lambda t: F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), lambda t: F.regexp_replace(t, URL, ""))


def remove_emails(c: Column) -> Column:
    return _where(c, lambda t: F.contains(t, F.lit("@")), lambda t: F.regexp_replace(t, EMAIL, ""))


def remove_phones(c: Column) -> Column:
    """Sentinels at the ends let numbers there have neighbours; two passes, as neighbours are shared."""
    return _where(c, lambda t: F.contains(t, F.lit("+")) | t.rlike("[0-9]{7}"), _phones)


def _phones(c: Column) -> Column:
    c = F.concat(F.lit(SENTINEL), c, F.lit(SENTINEL))
    for pattern, digits in ((MOBILE, MOBILE_DIGITS), (LANDLINE, LANDLINE_DIGITS)):
        twice = lambda t, p=pattern: F.regexp_replace(F.regexp_replace(t, p, "$1$2"), p, "$1$2")
        c = _where(c, lambda t, d=digits: t.rlike(d), twice)
    return bound(c, lambda t: F.substring(t, F.lit(2), F.length(t) - 2))


STEPS = {
    "tags": strip_tags, "entities": unescape_common, "odd": odd_to_space, "width": half_width, "runs": collapse_runs, "brackets": remove_brackets,
    "urls": remove_urls, "emails": remove_emails, "phones": remove_phones,
}

#: The same for texts of Latin-1 characters without "&". Their classes are single characters up to
#: U+00FF, which Java's patterns look up in one table instead of asking range by range.
LATIN_ODD = "[" + "".join(f"\\x{{{x:04X}}}" for x in [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0xA0, 0xAD]) + "]"
LATIN_STEPS = STEPS | {
    "entities": lambda c: c, "width": lambda c: c, "odd": lambda c: F.regexp_replace(c, LATIN_ODD, " "),
    "runs": lambda c: collapse_runs(c, "".join(x for x in RUNS if ord(x) < 256)), "brackets": lambda c: remove_brackets(c, PAIRS[:3]),
}


def clean(c: Column, steps: tuple[str, ...] = tuple(STEPS)) -> Column:
    """The steps in order; "all_entities" stands for the full table in place of "entities"."""

    def run(c: Column, table: dict) -> Column:
        for s in steps:
            c = unescape(c) if s == "all_entities" else table[s](c)
        return c

    if "all_entities" in steps or len({"odd", "width", "runs", "brackets"} & set(steps)) < 2:
        return run(c, STEPS)
    other = lambda t: F.contains(t, F.lit("&")) | t.rlike(r"[^\x00-\x{00FF}]")
    return bound(c, lambda t: F.when(other(t), run(t, STEPS)).otherwise(run(t, LATIN_STEPS)))


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def double_dollars(c: Column) -> Column:
    """Markdown: $ doubled on lines that don't begin with one."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(F.startswith(x, F.lit("$")), x).otherwise(F.replace(x, F.lit("$"), F.lit("$$")))), "\n")
