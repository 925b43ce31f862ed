"""Measures of topic models: coherence, diversity, distances, significance, human tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.information import divergence, pointwise
from lexmill.plans.storage import cut


def co_documents(top: DataFrame, tf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, a, ra, b, rb, both, da, db) for pairs of a topic's top words, a ranked above b, and the number of documents.

    Only documents' top words are paired, and these are bounded by the top list.
    """
    words = top.select("token").distinct()
    docs = tf.join(F.broadcast(words), "token").select("doc_id", "token").distinct()
    single = docs.groupBy("token").agg(F.count("*").alias("d"))
    pairs = top.alias("x").join(top.alias("y"), F.expr("x.topic = y.topic and x.rank < y.rank")).select("x.topic", F.col("x.token").alias("a"), F.col("x.rank").alias("ra"), F.col("y.token").alias("b"), F.col("y.rank").alias("rb"))
    by_doc = docs.groupBy("doc_id").agg(F.collect_set("token").alias("ws"))
    both = by_doc.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    found = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(both.withColumnsRenamed({"a": "lo", "b": "hi"}), ["lo", "hi"], "left")
    found = found.join(single.withColumnsRenamed({"token": "a", "d": "da"}), "a").join(single.withColumnsRenamed({"token": "b", "d": "db"}), "b")
    n = tf.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))
    return found.select("topic", "a", "ra", "b", "rb", F.coalesce("both", F.lit(0)).alias("both"), "da", "db"), n


def u_mass(pairs: DataFrame) -> DataFrame:
    """(topic, u_mass): mean of log((co-documents + 1) / documents of the higher word)."""
    return pairs.groupBy("topic").agg(F.avg(F.log((F.col("both") + 1) / F.col("da"))).alias("u_mass"))


def c_uci(pairs: DataFrame, n_docs: DataFrame, least: float = 1e-12) -> DataFrame:
    """(topic, c_uci, c_npmi) by document co-occurrence."""
    p = pairs.crossJoin(F.broadcast(n_docs)).select("topic", (F.col("both") / F.col("n_docs") + least).alias("p"), (F.col("da") / F.col("n_docs")).alias("px"), (F.col("db") / F.col("n_docs")).alias("py"))
    return pointwise(p).groupBy("topic").agg(F.avg("pmi").alias("c_uci"), F.avg("npmi").alias("c_npmi"))


def diversity(top: DataFrame) -> DataFrame:
    """One row: share of the top words that only one topic has."""
    by_word = top.groupBy("token").agg(F.count("*").alias("n"))
    return by_word.agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("diversity"))


def rank_overlap(a: Column, b: Column, depth: int) -> Column:
    """Mean over depths of the common items of two ranked lists' heads, as a share of the items of either."""

    def at(d: Column) -> Column:
        x, y = F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(depth)), at), F.lit(0.0), lambda s, x: s + x) / depth


def topic_overlap(top: DataFrame, depth: int) -> DataFrame:
    """(topic_a, topic_b, overlap, inverted) of topics' ranked top words."""
    ranked = top.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("x")).select("topic", F.transform("x", lambda x: x["token"]).alias("ws"))
    pairs = ranked.alias("x").join(ranked.alias("y"), F.expr("x.topic < y.topic"))
    overlap = rank_overlap(F.col("x.ws"), F.col("y.ws"), depth)
    return pairs.select(F.col("x.topic").alias("topic_a"), F.col("y.topic").alias("topic_b"), overlap.alias("overlap"), (1 - overlap).alias("inverted"))


def topic_distances(topic_word: DataFrame, least: float = 1e-9) -> DataFrame:
    """(topic_a, topic_b, kl, log_odds): distances of topics' words by shared words; a missing word has the probability `least`.

    log_odds is the mean absolute difference of log-odds over the words of either. Words
    are joined to words; what only one topic has is counted by sums, not filled in.
    """
    t = topic_word.select("topic", "token", "p")
    lo = lambda p: F.log(p / (1 - p))
    lowest = F.log(F.lit(least) / (1 - F.lit(least)))
    alone = t.groupBy("topic").agg(F.sum(divergence(F.col("p"), F.lit(least))).alias("kl0"), F.sum(F.abs(lo(F.col("p")) - lowest)).alias("lo0"), F.count("*").alias("n"))
    shared = t.alias("x").join(t.alias("y"), F.expr("x.token = y.token and x.topic <> y.topic"))
    px, py = F.col("x.p"), F.col("y.p")
    sums = shared.groupBy(F.col("x.topic").alias("topic_a"), F.col("y.topic").alias("topic_b")).agg(
        F.sum(divergence(px, py) - divergence(px, F.lit(least))).alias("dkl"), F.sum(F.abs(lo(px) - lo(py)) - F.abs(lo(px) - lowest) - F.abs(lo(py) - lowest)).alias("dlo"), F.count("*").alias("both")
    )
    a, b = alone.withColumnsRenamed({"topic": "topic_a"}), alone.select(F.col("topic").alias("topic_b"), F.col("lo0").alias("lo1"), F.col("n").alias("n1"))
    found = a.join(b, F.col("topic_a") != F.col("topic_b")).join(sums, ["topic_a", "topic_b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select("topic_a", "topic_b", (F.col("kl0") + zero("dkl")).alias("kl"), ((F.col("lo0") + F.col("lo1") + zero("dlo")) / (F.col("n") + F.col("n1") - zero("both"))).alias("log_odds"))


def significance(topic_word: DataFrame, words: DataFrame, doc_topic: DataFrame) -> DataFrame:
    """(topic, uniform, vacuous, background): divergences of a topic from even words, from p(w), and of its documents from even documents."""
    size = words.agg(F.count("*").alias("v"))
    joined = topic_word.join(words.select("token", F.col("p").alias("pw")), "token").crossJoin(F.broadcast(size))
    by_word = joined.groupBy("topic").agg(F.sum(divergence(F.col("p"), 1 / F.col("v"))).alias("uniform"), F.sum(divergence(F.col("p"), F.col("pw"))).alias("vacuous"))
    n = doc_topic.select("doc_id").distinct().agg(F.count("*").alias("d"))
    mass = doc_topic.groupBy("topic").agg(F.sum("p").alias("m"))
    share = doc_topic.join(mass, "topic").crossJoin(F.broadcast(n)).withColumn("q", F.col("p") / F.col("m"))
    background = share.groupBy("topic").agg(F.sum(divergence(F.col("q"), 1 / F.col("d"))).alias("background"))
    return by_word.join(background, "topic")


def centroid_similarity(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, cosine) of the groups' mean vectors."""
    long = vectors.select(key, F.posexplode(vector).alias("k", "v"))
    mean = long.groupBy(key, "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    norm = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    pairs = mean.alias("x").join(mean.alias("y"), F.expr(f"x.k = y.k and x.{key} < y.{key}")).groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("dot"))
    first, second = norm.select(F.col(key).alias("a"), F.col("norm").alias("na")), norm.select(F.col(key).alias("b"), F.col("norm").alias("nb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def c_v(pairs: DataFrame, n_docs: DataFrame, least: float = 1e-12) -> DataFrame:
    """(topic, c_v): mean cosine of each top word's NPMI vector over the top words and the sum of these vectors."""
    p = pairs.crossJoin(F.broadcast(n_docs)).select("topic", "a", "b", (F.col("both") / F.col("n_docs") + least).alias("p"), (F.col("da") / F.col("n_docs")).alias("px"), (F.col("db") / F.col("n_docs")).alias("py"))
    one = cut(pointwise(p).select("topic", "a", "b", "npmi"))  # read four times below
    words = one.select("topic", "a").unionByName(one.select("topic", F.col("b").alias("a"))).distinct()
    table = one.unionByName(one.select("topic", F.col("b").alias("a"), F.col("a").alias("b"), "npmi")).unionByName(words.select("topic", "a", F.col("a").alias("b"), F.lit(1.0).alias("npmi")))
    total = table.groupBy("topic", "b").agg(F.sum("npmi").alias("s"))
    cos = table.join(total, ["topic", "b"]).groupBy("topic", "a").agg((F.sum(F.col("npmi") * F.col("s")) / F.sqrt(F.sum(F.col("npmi") * F.col("npmi")) * F.sum(F.col("s") * F.col("s")))).alias("cos"))
    return cos.groupBy("topic").agg(F.avg("cos").alias("c_v"))


def word_vectors(docs: DataFrame, tokens: str = "tokens", size: int = 32, least_count: int = 5, seed: int = 1, docs_each: int = 10_000) -> DataFrame:
    """(token, vector) by Word2Vec over arrays of tokens.

    One task trains on about docs_each documents, and the tasks' vectors are averaged: by
    default one task had to train on all. The number of tasks follows from the documents,
    not from the cores.
    """
    parts = max(1, -(-docs.count() // docs_each))
    model = Word2Vec(vectorSize=size, minCount=least_count, seed=seed, numPartitions=parts, inputCol=tokens, outputCol="__out").fit(docs.select(tokens))
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def c_w2v(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic, c_w2v): mean cosine of the pairs of a topic's top words that have vectors."""
    v = top.join(vectors, "token").select("topic", "rank", "vector")
    pairs = v.alias("x").join(v.alias("y"), F.expr("x.topic = y.topic and x.rank < y.rank"))
    return pairs.groupBy(F.col("x.topic").alias("topic")).agg(F.avg(cosine(F.col("x.vector"), F.col("y.vector"))).alias("c_w2v"))


def matched_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over depths of the cosines of the heads' vectors, matched greedily from the closest pair on, each vector once."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near, depth, total = unit(a) @ unit(b).T, min(len(a), len(b)), 0.0
    for d in range(1, depth + 1):
        m, got = near[:d, :d].copy(), 0.0
        for _ in range(d):
            i, j = np.unravel_index(int(np.argmax(m)), m.shape)
            got += m[i, j]
            m[i, :] = m[:, j] = -np.inf
        total += got / d
    return total / depth if depth else 0.0


def embedding_overlap(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic_a, topic_b, overlap, inverted) of topics' ranked top words by their vectors; the lists are short."""
    v = top.join(vectors, "token").groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "vector"))).alias("x")).select("topic", F.transform("x", lambda x: x["vector"]).alias("vs"))
    pairs = v.alias("x").join(v.alias("y"), F.expr("x.topic < y.topic")).select(F.col("x.topic").alias("topic_a"), F.col("y.topic").alias("topic_b"), F.col("x.vs").alias("a"), F.col("y.vs").alias("b"))

    @F.pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_overlap(np.stack(x), np.stack(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.select("topic_a", "topic_b", overlap("a", "b").alias("overlap")).withColumn("inverted", 1 - F.col("overlap"))


def word_intrusion(hits: Column) -> Column:
    """Share of subjects that found the intruder."""
    return F.avg(hits.cast("double"))


def topic_intrusion(true_p: Column, chosen_p: Column) -> Column:
    """Mean log ratio of the true intruder's probability to the chosen topics'."""
    return F.avg(F.log(true_p) - F.log(chosen_p))
