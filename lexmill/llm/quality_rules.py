"""Quality rules with thresholds from quantile sketches for each language and source.

Counts come from each whole text in one projection, without a shuffle: a text's repeated
3-word windows are found by sorting the hashes of its own windows. The counts give four
whole-number measures (`MEASURES`, per mille or tenths). A sketch is the counts of a
measure's values for a language and source, values over `SPREAD` buckets folded
logarithmically: sketches merge by adding, the merge order does not matter, and quantiles
are exact to a bucket. A sketch of under `least_rows` documents is merged up: to its
language's, then to the whole corpus's.

A measure's bound is its upper quartile plus `fence` times its spread (upper quartile
minus lower one, `least_spread` at least); for words' length also a lower bound. A text is
kept if it passes the base rule and no measure is out of its bounds. The sketches have
bounded size, so the bounds join as a table of groups; a hot source is summed up before
its rows meet.

Null texts have no words and fail the base rule. Null languages and sources are groups of
their own. Rows are answered each, repeated ones too. Columns other than the results are
kept (`keep`); a result replaces an input column of its name. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written

SPACE = " \t\n\x0b\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measure: SQL over the counts, and the least spread of its fence.
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 15),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 60),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_words, 1)", 15),
    "word_length": ("10 * word_chars div greatest(n_words, 1)", 8),
}
#: Measure values from here on share logarithmic buckets.
SPREAD = 2000


def words_of(text: Column) -> Column:
    """The text's words: runs of anything but ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * 5), " +"), lambda w: w != "")


def _repeats(words: Column) -> Column:
    """Words in 3-word windows found twice or more, by sorted (hash of the window, place)."""
    n = F.size(words)
    places = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 4, F.sort_array(places)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with the columns COUNTS."""
    out = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in out]).alias("__row"), t.alias("__t")) if out else docs.select(F.struct().alias("__row"), t.alias("__t"))
    bare = lambda c, drop: F.length(c) - F.length(F.translate(c, drop, ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    df = df.select("__row", "__t", words_of(F.col("__t")).alias("__w"), lines.alias("__l"))
    df = df.select(
        "__row", F.size("__w").cast("long").alias("n_words"), (F.length("__t") - bare(F.col("__t"), SPACE)).cast("long").alias("word_chars"),
        bare(F.col("__t"), "#*$%&|<>").cast("long").alias("n_symbols"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("__w")).alias("__s"),
    )
    # windows that have their hash beside them in the order, by place; each covers the words up to the next one's start
    s = F.col("__s")
    same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    df = df.select("__row", *COUNTS[:4], F.sort_array(F.transform(same, lambda x: x["i"])).alias("__p"))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", covered)
    return df.select(*[F.col("__row")[c].alias(c) for c in out], *COUNTS)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def bucket(value: str) -> str:
    """A measure's value as a sketch's bucket: itself, or its size in binary digits from SPREAD on."""
    return f"if({value} < {SPREAD}, {value}, cast(pow(2, length(bin({value}))) as bigint))"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, v, n): counts of each bucket; rows that fail the base rule don't set thresholds."""
    stacked = "stack({}, {}) as (measure, v)".format(len(MEASURES), ", ".join(f"'{m}', {bucket(m)}" for m in MEASURES))
    return measured.where(~F.col("base_failed")).select("lang", "source", F.expr(stacked)).groupBy("lang", "source", "measure", "v").agg(F.count("*").alias("n"))


def _fences(found: DataFrame, keys: list[str], fence: float) -> DataFrame:
    """(keys, measure, total, low, high) from the sketches merged to the keys."""
    group = [*keys, "measure"]
    merged = found.groupBy(*group, "v").agg(F.sum("n").alias("n"))
    running = merged.select(*group, "v", F.sum("n").over(Window.partitionBy(*group).orderBy("v")).alias("up_to"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    quartiles = running.groupBy(*group).agg(F.max("total").alias("total"), F.expr("min(if(4 * up_to >= total, v, null))").alias("q1"), F.expr("min(if(4 * up_to >= 3 * total, v, null))").alias("q3"))
    least = F.expr("case measure " + " ".join(f"when '{m}' then {s}" for m, (_, s) in MEASURES.items()) + " end")
    spread = fence * F.greatest(F.col("q3") - F.col("q1"), least)
    return quartiles.select(*group, "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def bounds(found: DataFrame, least_rows: int = 200, fence: float = 3.0) -> DataFrame:
    """One row for each language and source: m_low and m_high of each measure m."""
    own, by_lang, whole = _fences(found, ["lang", "source"], fence).alias("s"), _fences(found, ["lang"], fence).alias("l"), _fences(found, [], fence).alias("w")
    rows = own.join(by_lang, F.expr("s.lang <=> l.lang and s.measure = l.measure")).join(F.broadcast(whole), F.expr("s.measure = w.measure"))
    pick = lambda c: F.expr(f"case when s.total >= {least_rows} then s.{c} when l.total >= {least_rows} then l.{c} else w.{c} end")
    rows = rows.select("s.lang", "s.source", "s.measure", pick("low").alias("low"), pick("high").alias("high"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("low", "high")])


def apply_rules(docs: DataFrame, least_rows: int = 200, fence: float = 3.0, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with COUNTS, base_failed and kept."""
    results = [*COUNTS, "base_failed", "kept"]
    out = [c for c in (docs.columns if keep is None else keep) if c not in results]
    grouped = docs.withColumns({"__lang": F.col("lang"), "__source": F.col("source")})
    df = counted(grouped, text, [*out, "__lang", "__source"]).withColumn("base_failed", base_failed())
    df = written(df, "counted")
    measured = df.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), "base_failed", *[F.expr(m).alias(name) for name, (m, _) in MEASURES.items()])
    found = bounds(sketches(measured), least_rows, fence).withColumnsRenamed({"lang": "__l", "source": "__s"})
    inside = F.expr(" and ".join(f"coalesce({m} <= {name}_high, true)" + f" and coalesce({m} >= {name}_low, true)" * (name == "word_length") for name, (m, _) in MEASURES.items()))
    df = df.join(found, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    return df.withColumn("kept", ~F.col("base_failed") & inside).select(*[F.col(f"`{c}`") for c in out], *results)


def op3(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def _sql3(least_rows: int = 200, fence: float = 3.0) -> str:
    level = lambda n, *keys: f"select {n} level, {', '.join([*keys, *['null'] * (2 - len(keys))])}, measure, v, sum(n) n from sk group by {', '.join([*keys, 'measure', 'v'])}"
    sized = lambda m: f"case when {m} < {SPREAD} then {m} else cast(pow(2, length(bin({m}))) as bigint) end"
    measure = lambda m: m.replace(" div ", " // ")
    least = "case measure " + " ".join(f"when '{m}' then {s}" for m, (_, s) in MEASURES.items()) + " end"
    inside = " and ".join(f"{m} <= max(case when measure = '{m}' then high end)" + f" and {m} >= max(case when measure = '{m}' then low end)" * (m == "word_length") for m in MEASURES)
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) l from documents),
win as (select doc_id, i, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3)),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 3)) p from (select *, count(*) over (partition by doc_id, g) c from win) where c > 1) group by 1),
c as (
    select d.doc_id, lang, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(coalesce(rep.n, 0) as bigint) n_repeat_words from d left join rep using (doc_id)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {", ".join(f"{measure(e)} {m}" for m, (e, _) in MEASURES.items())} from c),
sk as (select lang, source, measure, v, count(*) n from ({" union all ".join(f"select lang, source, '{m}' measure, {sized(m)} v from m where not base_failed" for m in MEASURES)}) group by all),
merged as ({level(2, "lang", "source")} union all {level(1, "lang")} union all {level(0)}),
running as (select *, sum(n) over (partition by level, lang, source, measure order by v) up_to, sum(n) over (partition by level, lang, source, measure) total from merged),
q as (select level, lang, source, measure, max(total) total, min(case when 4 * up_to >= total then v end) q1, min(case when 4 * up_to >= 3 * total then v end) q3 from running group by all),
f as (select *, q1 - {fence} * greatest(q3 - q1, {least}) low, q3 + {fence} * greatest(q3 - q1, {least}) high from q),
b as (
    select s.lang, s.source, s.measure, case when s.total >= {least_rows} then s.low when l.total >= {least_rows} then l.low else w.low end low,
    case when s.total >= {least_rows} then s.high when l.total >= {least_rows} then l.high else w.high end high
    from f s join f l on l.level = 1 and s.lang is not distinct from l.lang and s.measure = l.measure join f w on w.level = 0 and s.measure = w.measure where s.level = 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, true) kept
from m left join b on m.lang is not distinct from b.lang and m.source is not distinct from b.source group by doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(MEASURES)}
"""


SQL3 = _sql3()
