"""Line dedup by a log-template tree of fixed depth.

1. A line's words are taken in ASCII lower case; words with a digit are variable fields
   and become a wildcard.
2. The tree: first the number of words, then each of the `depth` leading words. In a leaf
   lines are compared place by place: the remaining places are dealt in turn to `CLASSES`
   classes, and lines that agree in all but `FREE` of the classes share a template, whose
   other places are variable. So lines that differ in any two words after the leading ones
   always meet in a template, and a template's lines agree in its leading words and about
   three of five others at least (six words of eight). Lines of under `least_words` words
   are too short for a free field: they must agree as a whole.
3. A template found in `least_docs` documents or more recurs (`short_docs` for short lines,
   whose chance repetition is normal prose). Its lines are dropped, but for those of the
   document with the smallest id (`keep_first`), so that the content stays in the corpus
   once.

Lines travel as hashes: of the leaf (64 bits), and of each class (32 bits; they count only
within the leaf). Leaves that only one document has are left out at once, then the lines
of the others are made distinct; so a very common line is one row for each task, and
templates are made of distinct lines. Joins have unique rows on one side and are split by
Spark where a leaf or template is hot. Texts are moved once at most, to meet their dropped
line numbers.

A row is known by its doc_id and text: repeated rows share their decisions. Rows without
an id count together as one document, the last. Null texts have no lines and stay null;
empty ones have one empty line. Lines without a word stay. Documents may lose all their
lines and then have an empty text; no row goes. Other columns are kept, but for those named
like a result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import lower_ascii, written

SPACES = " \t\x0b\f\r"
FIELD = "<*>"
LAST = (1 << 63) - 1
#: Classes of a line's places after the leading ones, and how many of them may differ.
CLASSES, FREE = 5, 2


def _masked(text: Column) -> Column:
    """The text in lower case, with spaces as its only white space but for line ends, and words that hold a digit as wildcards; possessive parts keep long words linear."""
    return F.translate(F.regexp_replace(lower_ascii(text), r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD), SPACES[1:], " " * 4)


def _lines(text: Column, depth: int) -> Column:
    """(line, n words, leaf, c0, c1, ...) of each line with words."""

    def one(line: Column, i: Column) -> Column:
        # a one-element array binds the words to a name: they are split once
        own = lambda w, c: F.when(F.size(w) > depth + c, F.hash(F.transform(F.sequence(F.lit(depth + c + 1), F.size(w), F.lit(CLASSES)), lambda k: F.element_at(w, k)))).otherwise(F.lit(0))
        row = lambda w: F.struct(i.cast("int").alias("line"), F.size(w).alias("n"), F.xxhash64(F.size(w), F.slice(w, 1, depth)).alias("leaf"), *[own(w, c).alias(f"c{c}") for c in range(CLASSES)])
        return F.element_at(F.transform(F.array(F.array_remove(F.split(line, " "), "")), row), 1)

    return F.filter(F.transform(F.split(_masked(text), "\n", -1), one), lambda x: x["n"] > 0)


def _templates() -> Column:
    """A template for each choice of the classes that must agree."""
    kept = combinations(range(CLASSES), CLASSES - FREE)
    return F.explode(F.array(*[F.xxhash64("leaf", F.lit(",".join(map(str, own))), *[f"c{c}" for c in own]) for own in kept]))


def recurring(lines: DataFrame, least_docs: int = 2) -> DataFrame:
    """(template, first): the templates of (template, first, last) in least_docs documents or more, and the smallest document of each.

    A row is what one document or more have between first and last; for more than two
    documents each row must be of one.
    """
    if least_docs == 2:
        found = lines.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        return found.where("first < last").select("template", "first")
    found = lines.select("template", "first").distinct().groupBy("template").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least_docs).select("template", "first")


def _marked(lines: DataFrame, least_words: int, least_docs: int, short_docs: int) -> DataFrame:
    """(whole, first): the distinct lines that have a recurring template, and the smallest document of these."""
    classes = [f"c{c}" for c in range(CLASSES)]
    by_document = [] if least_docs == 2 else ["d"]
    distinct = lines.where(F.col("n") >= least_words).groupBy("whole", "leaf", *classes, *by_document).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    keyed = written(distinct.select("whole", "first", "last", _templates().alias("template")), "templates")
    found = keyed.select("whole", "template").join(written(recurring(keyed, least_docs), "recurring"), "template").groupBy("whole").agg(F.min("first").alias("first"))
    short = lines.where(F.col("n") < least_words).select(F.col("whole").alias("template"), F.col("d").alias("first"), F.col("d").alias("last"))
    return found.unionByName(recurring(short, short_docs).withColumnRenamed("template", "whole"))


def dedup_lines(docs: DataFrame, depth: int = 3, least_words: int = 8, least_docs: int = 2, short_docs: int = 5, keep_first: bool = True, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with their text less the dropped lines, n_lines and n_dropped."""
    if least_words < depth + CLASSES:
        raise ValueError(f"least_words must be {depth + CLASSES} or more, so that each class has a place")
    names = ["n_lines", "n_dropped"]
    out = [c for c in (docs.columns if keep is None else keep) if c not in names]
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    t = F.col(f"`{text}`")
    found = docs.select(d.alias("d"), F.xxhash64(t).alias("h"), F.explode(_lines(F.coalesce(t, F.lit("")), depth)).alias("x"))
    lines = written(found.select("d", "h", "x.*"), "lines")
    # read from a table, both sides of the joins are plain exchanges, and Spark can split a hot key's rows
    leaves = lines.groupBy("leaf").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("leaf")
    whole = F.xxhash64("leaf", *[f"c{c}" for c in range(CLASSES)])
    lines = written(lines.join(written(leaves, "leaves"), "leaf").withColumn("whole", whole), "shared")
    marked = lines.select("d", "h", "line", "whole").join(written(_marked(lines, least_words, least_docs, short_docs), "marked"), "whole")
    if keep_first:
        marked = marked.where("d > first")
    dropped = marked.groupBy("d", "h").agg(F.collect_set("line").alias("dropped"))
    dropped = written(dropped, "dropped").withColumnsRenamed({"d": "__d", "h": "__h", "dropped": "__dropped"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none")).alias("__row"), t.alias("__t"), d.alias("__d"), F.xxhash64(t).alias("__h"))
    rows = rows.join(dropped, ["__d", "__h"], "left").select("__row", "__t", "__dropped", F.split("__t", "\n", -1).alias("__lines"))
    places = F.array_except(F.sequence(F.lit(1), F.size("__lines")), F.transform("__dropped", lambda i: i + 1))
    # n and text may clash with columns of the input: results come from names of their own
    kept = F.when(F.col("__dropped").isNull(), F.col("__t")).otherwise(F.array_join(F.transform(places, lambda i: F.get("__lines", i - 1)), "\n"))
    n_lines = F.when(F.col("__t").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    rows = rows.select("__row", kept.alias("__text"), n_lines.alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("__n"))
    return rows.select(*[F.col("__text").alias(c) if c == text else F.col("__row")[c].alias(c) for c in out], "n_lines", F.greatest("__n", F.lit(0)).alias("n_dropped"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id", "text"])
    return found.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _sql7(depth: int = 3, least_words: int = 8, least_docs: int = 2, short_docs: int = 5) -> str:
    words = "list_transform(list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end)"
    free = ", ".join(f"({i}, {list(x)})" for i, x in enumerate(combinations(range(CLASSES), FREE)))
    place = f"list_filter(range(1, len(w) + 1), lambda k: k <= {depth} or not list_contains(free, (k - {depth + 1}) % {CLASSES}))"
    return rf"""
with d as (select doc_id, row_number() over () row_no, coalesce(doc_id, {LAST}) d, text, string_split(text, chr(10)) ls from documents),
l as (select row_no, d, i, ls[i] x from (select *, unnest(range(1, len(ls) + 1)) i from d)),
w as (select row_no, d, i, {words} w from l),
k as (
    select row_no, d, i, c, len(w) n, array_to_string(list_transform({place}, lambda k: w[k]), ' ') s from w, (values {free}) v(c, free) where len(w) >= {least_words}
    union all select row_no, d, i, -1, len(w), array_to_string(w, ' ') from w where len(w) between 1 and {least_words - 1}),
r as (select c, n, s, min(d) first from k group by all having count(distinct d) >= case when c < 0 then {short_docs} else {least_docs} end),
gone as (select distinct row_no, i from k join r using (c, n, s) where d > first),
t as (select row_no, string_agg(x, chr(10) order by i) filter (gone.i is null) t, count(gone.i) n_dropped, count(*) n_lines from l left join gone using (row_no, i) group by 1)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, coalesce(length(t), 0) n_chars, sha256(coalesce(t, '')) text_sha256 from d left join t using (row_no)
"""


SQL7 = _sql7()
