"""Where a pattern's matches stand in a text, in Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is known of a match: its place in code points (end exclusive), itself, and the text beside it.
MATCH = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"
BLOCK = 256


def located(text: Column, pattern: Column | str, matches: Column, beside: int = 48) -> Column:
    """The matches (regexp_extract_all's, not null) with their places, leftmost and not overlapping.

    What split() leaves between the matches gives their places as running sums. These are
    taken over blocks of BLOCK matches, so that the work grows with the matches' number
    and not with its square. before and after reach at most to the neighbouring match.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    pieces, n = F.split(text, p, -1), F.size(matches)
    steps = F.zip_with(
        F.zip_with(F.slice(pieces, 1, n), matches, lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m.alias("text"), F.substring(gap, -beside, beside).alias("before"))),
        F.slice(pieces, 2, n), lambda x, gap: F.struct(x["gap"].alias("gap"), x["text"].alias("text"), x["before"].alias("before"), F.substring(gap, 1, beside).alias("after")),
    )
    return F.when(n > 0, _summed(steps)).otherwise(F.array().cast(MATCH))


def _summed(steps: Column) -> Column:
    zero = F.lit(0).cast("long")
    size = lambda x: x["gap"] + F.length(x["text"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))

    def places(first: Column, block: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            start, end = done["at"] + x["gap"], done["at"] + size(x)
            one = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(first.alias("at"), F.array().cast(MATCH).alias("out")), add)["out"]

    def with_starts(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + size(x)))
        return F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda done, x: F.struct((done["at"] + x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")))["out"]

    # transform over a one-element array binds the blocks to a name: they are cut once
    bound = F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(with_starts(bs), bs, places)))
    return F.element_at(bound, 1)


def matches_of(text: Column, pattern: Column | str, gate: Column | None = None) -> Column:
    """The pattern's matches as strings; none where the gate is not true."""
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast("array<string>"))
