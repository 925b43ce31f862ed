"""Retrieval by BM25, and selection by maximal marginal relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.terms import top


def bm25(queries: DataFrame, tf: DataFrame, k1: float = 1.5, b: float = 0.75, k3: float | None = None, clamp: bool = False, n: int | None = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the n best documents of each query.

    queries is (query_id, token, qtf), tf is (doc_id, token, tf). idf is
    ln((N - df + 0.5) / (df + 0.5) + 1); with clamp the form without + 1, not below 0. k3
    saturates repeated words of long queries. Words of no query are dropped before the
    shuffle of the postings.
    """
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    size = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    words = queries.select("token").distinct()
    postings = tf.join(words, "token", "left_semi")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weight = F.greatest(F.log(ratio), F.lit(0.0)) if clamp else F.log(ratio + 1)
    terms = queries.join(df, "token").crossJoin(F.broadcast(size)).withColumn("idf", weight)
    q = F.lit(1.0) if k3 is None else (k3 + 1) * F.col("qtf") / (k3 + F.col("qtf"))
    part = q * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = terms.join(postings, "token").join(lengths, "doc_id").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    return scored if n is None else top(scored, n, ["query_id"], F.desc(F.round("score", 9)), F.asc("doc_id"))


def mmr(items: DataFrame, key: str, relevance: str, vector: str, n: int = 5, weight: float = 0.5) -> DataFrame:
    """(key, item, score, rank): n items of each key, each the best of weight * relevance - (1 - weight) * its largest cosine to those taken.

    The choice is sequential over n rounds; in each, all items of all keys are compared where
    they lie, and only a best item for each key is shuffled. Items are known by their ids.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    given = items.select(F.col(key).alias("key"), "item", F.col(relevance).cast("double").alias("relevance"), F.col(vector).cast("array<double>").alias("vector"))
    unit = F.transform("vector", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-12)))
    given = given.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector")))).select("key", "item", "relevance", unit.alias("vector"))
    none = F.array().cast(f"array<struct<value:double,item:{dict(given.dtypes)['item']},score:double,vector:array<double>>>")
    taken = given.select("key").distinct().withColumn("taken", none)
    near = F.coalesce(F.array_max(F.transform("taken", lambda x: dot(x["vector"], F.col("vector")))), F.lit(0.0))
    value = weight * F.col("relevance") - (1 - weight) * near
    is_free = ~F.exists("taken", lambda x: x["item"] == F.col("item"))
    for _ in range(n):
        rows = given.join(F.broadcast(taken), "key").withColumn("score", value)
        best = F.min(F.when(is_free, F.struct((-F.round("score", 9)).alias("value"), "item", "score", "vector")))
        rows = rows.groupBy("key").agg(F.first("taken").alias("taken"), best.alias("best"))
        taken = rows.select("key", F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("best"))).alias("taken"))
    found = taken.select("key", F.posexplode("taken").alias("at", "x"))
    return found.select("key", "x.item", "x.score", (F.col("at") + 1).cast("long").alias("rank"))
