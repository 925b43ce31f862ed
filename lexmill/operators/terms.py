"""Term statistics: frequencies, vocabulary, bag of words, weights.

Tokens are long tables (doc_id, pos, token), as wide rows would not spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.split import sentences
from lexmill.functions.tokens import tokenize
from lexmill.operators import batches
from lexmill.operators.dataset import row_index
from lexmill.plans.storage import cut


def explode_tokens(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def document_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, token)"""
    return explode_tokens(docs, tokenize(F.col(text)), "doc_id")


def document_sentences(docs: DataFrame, criterion: str = "coarse", text: str = "text") -> DataFrame:
    """(doc_id, idx, sentence)"""
    return docs.select("doc_id", F.posexplode(sentences(F.col(text), criterion)).alias("idx", "sentence"))


def term_frequency(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, tf); keys default to doc_id."""
    return tokens.groupBy(*(keys or ("doc_id",)), "token").agg(F.count("*").alias("tf"))


def row_frequency(docs: DataFrame, tokens: Column, *more: str, key: str = "doc_id") -> DataFrame:
    """(key, more, token, tf) of documents: a row's tokens are counted in one pass; only where rows share a key they meet by it, and then without the columns `more`."""
    fields = [T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())]
    if batches.one_row_each(docs, key):
        return batches.map_tokens(docs, [key, *more], tokens, fields, batches.counts)
    return batches.map_tokens(docs, [key], tokens, fields, batches.counts).groupBy(key, "token").agg(F.sum("tf").alias("tf"))


def relative_frequency(tf: DataFrame) -> DataFrame:
    """(doc_id, token, tf, rel): rel is the share of the document's tokens."""
    totals = tf.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    return tf.join(totals, "doc_id").select("doc_id", "token", "tf", (F.col("tf") / F.col("n")).alias("rel"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(token, df, cf): documents with the token, and its places; tf has a row for each document and token."""
    return tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary(df: DataFrame, n_docs: int, no_below: int = 5, no_above: float = 0.5, keep_n: int | None = 100_000) -> DataFrame:
    """(token_id, token, df): tokens in at least no_below documents and at most a share of no_above, the keep_n most frequent; ids follow the token's order."""
    kept = df.where((F.col("df") >= no_below) & (F.col("df") <= no_above * n_docs)).select("token", "df")
    if keep_n is not None:
        kept = kept.orderBy(F.desc("df"), "token").limit(keep_n)
        # at most keep_n rows: the numbering is small by the operator's definition
        return kept.select((F.row_number().over(Window.orderBy("token")) - 1).cast("long").alias("token_id"), "token", "df")
    return row_index(kept, ["token"], "token_id").select("token_id", "token", "df")


def bag_of_words(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, token_id, cnt); tokens outside of the vocabulary go."""
    return tf.join(vocab, "token").select("doc_id", "token_id", F.col("tf").alias("cnt"))


def doc_lengths(bow: DataFrame) -> DataFrame:
    return bow.groupBy("doc_id").agg(F.sum("cnt").alias("length"))


def idf(df: DataFrame, n_docs: int, kind: str = "log2") -> DataFrame:
    """(token, weight): log2(N / df), or its natural logarithm with kind "ln"."""
    ratio = F.lit(float(n_docs)) / F.col("df")
    return df.select("token", (F.log2(ratio) if kind == "log2" else F.log(ratio)).alias("weight"))


def tfidf(tf: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, token, score): relative frequency times weight."""
    return relative_frequency(tf).join(weights, "token").select("doc_id", "token", (F.col("rel") * F.col("weight")).alias("score"))


def top(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The first n rows of each key with their rank; Spark trims each task's rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def upper_median(df: DataFrame, value: str = "weight") -> DataFrame:
    """One row (n, upper_median): the value at place n // 2 of the sorted ones, by counts of equal values.

    Distinct values are dealt into ranges by value; running counts start from each range's
    total, so no task sees all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()))  # written once: the totals and the rows must see the same ranges
    starts = dealt.groupBy("part").agg(F.sum("c").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    running = dealt.join(F.broadcast(starts), "part").withColumn("upto", F.col("start") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    return running.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.max("total").alias("n"), F.min("v").alias("upper_median"))


def min_max(df: DataFrame, value: str = "weight") -> DataFrame:
    """The value scaled to 0..1; 0 where all are equal. The bounds are one row."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(bounds)).withColumn(value, scaled).drop("__lo", "__hi")


def merge_vocabularies(a: DataFrame, b: DataFrame, value: str = "weight") -> DataFrame:
    """(token, a, b): all tokens of either table, 0 where it has none."""
    left, right = a.select("token", F.col(value).alias("a")), b.select("token", F.col(value).alias("b"))
    return left.join(right, "token", "full_outer").select("token", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def vocabulary_union(*vocabularies: DataFrame) -> DataFrame:
    out = vocabularies[0].select("token")
    for v in vocabularies[1:]:
        out = out.unionByName(v.select("token"))
    return out.distinct()


def sentence_statistics(sents: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, avg_tokens, max_chars)"""
    counted = sents.select("doc_id", F.size(tokenize(F.col("sentence"))).alias("n"), F.length("sentence").alias("c"))
    return counted.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.avg("n").alias("avg_tokens"), F.max("c").alias("max_chars"))


def gazetteer(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(place): the names of both levels, each once."""
    return children.select("place").unionByName(parents.select("place")).where("place is not null").distinct()


def flatten_gazetteer(tree: DataFrame, column: str = "tree") -> DataFrame:
    """(place): names of a nested map province -> city -> array of counties; keys that begin with _ are no places."""
    level = tree.select(F.explode(column).alias("province", "cities")).where(~F.startswith("province", F.lit("_")))
    cities = level.select(F.explode("cities").alias("city", "counties")).where(~F.startswith("city", F.lit("_")))
    names = level.select(F.col("province").alias("place")).unionByName(cities.select(F.col("city").alias("place"))).unionByName(cities.select(F.explode("counties").alias("place")))
    return names.distinct()
