"""Sentence splitting as one split at zero-width places; the pieces joined give the text again.

P are the delimiters. A sentence ends before a front quote that follows a delimiter, after
a delimiter that is no quote and is followed by other text, and after a back quote that
follows a delimiter and is followed by other text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.clean import bound

FRONT, BACK = "“", "”"
#: Delimiters by criterion; the Latin ones are this library's own.
MARKS = {
    "coarse": "。“”！？\n",
    "fine": "，：。;“”；…！!?？\r\n",
    "latin_coarse": ".“”!?\n",
    "latin_fine": ",:.;“”…!?\r\n",
}


def marks(criterion: str) -> str:
    if criterion not in MARKS:
        raise ValueError(f"criterion must be one of {', '.join(MARKS)}: {criterion}")
    return MARKS[criterion]


def listed(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):04X}}}" for c in chars)


def boundary(criterion: str) -> str:
    """Each of the three ends follows a delimiter, which is asked for first."""
    p = marks(criterion)
    every, plain = listed(p), listed(p.replace(FRONT, "").replace(BACK, ""))
    return f"(?<=[{every}])(?:(?={FRONT})|(?<=[{plain}])(?=[^{every}])|(?<=[{every}]{BACK})(?=[^{every}]))"


def plain_boundary(criterion: str) -> str:
    """The same for a text without quotes."""
    plain = listed(marks(criterion).replace(FRONT, "").replace(BACK, ""))
    return f"(?<=[{plain}])(?=[^{plain}])"


def sentences(c: Column, criterion: str = "coarse") -> Column:
    """Array of sentences; null for null, empty for the empty text."""
    quoted = lambda t: F.contains(t, F.lit(FRONT)) | F.contains(t, F.lit(BACK))
    parts = bound(c, lambda t: F.when(quoted(t), F.split(t, boundary(criterion), -1)).otherwise(F.split(t, plain_boundary(criterion), -1)))
    return F.filter(parts, lambda s: s != "")
