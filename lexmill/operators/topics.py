"""Topic models and what is mined from them, as long tables.

topic_word (topic, token, p): p(w|t). doc_topic (doc_id, topic, p): p(t|d). lengths
(doc_id, length). An observed label can stand for the topic (`observed`), so that all of
this also works without a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import batches
from lexmill.plans.storage import cut


def observed(tf: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """topic_word, doc_topic and lengths of (doc_id, token, tf) with the document's label (doc_id, topic) as its topic; tf that has a column topic is not joined."""
    counts = (tf if "topic" in tf.columns else tf.join(labels, "doc_id")).groupBy("topic", "token").agg(F.sum("tf").alias("n"))
    counts = cut(counts)  # all tables of topics and words start from it: tf is summed once
    return shares(counts), labels.select("doc_id", "topic", F.lit(1.0).alias("p")), tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))


def shares(counts: DataFrame) -> DataFrame:
    """topic_word of (topic, token, n)."""
    totals = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(totals, "topic").select("topic", "token", (F.col("n") / F.col("total")).alias("p"))


def observed_marginals(counts: DataFrame) -> DataFrame:
    """`topic_marginals` of documents with one topic each, from (topic, token, n)."""
    mass = counts.groupBy("topic").agg(F.sum("n").cast("double").alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"))
    return mass.crossJoin(F.broadcast(total)).select("topic", (F.col("mass") / F.col("total")).alias("p"), "mass")


def topic_marginals(doc_topic: DataFrame, lengths: DataFrame) -> DataFrame:
    """(topic, p): topics weighed by the documents' lengths."""
    mass = doc_topic.join(lengths, "doc_id").groupBy("topic").agg(F.sum(F.col("p") * F.col("length")).alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"))
    return mass.crossJoin(F.broadcast(total)).select("topic", (F.col("mass") / F.col("total")).alias("p"), "mass")


def word_marginals(topic_word: DataFrame, topics: DataFrame) -> DataFrame:
    """(token, p): sum of p(w|t) p(t)."""
    t = topics.select("topic", F.col("p").alias("pt"))
    return topic_word.join(t, "topic").groupBy("token").agg(F.sum(F.col("p") * F.col("pt")).alias("p"))


def topics_of_words(topic_word: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(token, topic, p): p(t|w), with even topics if none are given."""
    weighed = topic_word if topics is None else topic_word.join(topics.select("topic", F.col("p").alias("pt")), "topic").withColumn("p", F.col("p") * F.col("pt"))
    total = weighed.groupBy("token").agg(F.sum("p").alias("total"))
    return weighed.join(total, "token").select("token", "topic", (F.col("p") / F.col("total")).alias("p"))


def estimated_frequency(topic_word: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, token, etf): how often a topic is expected to give the word."""
    return topic_word.join(topics.select("topic", "mass"), "topic").select("topic", "token", (F.col("p") * F.col("mass")).alias("etf"))


def relevance(topic_word: DataFrame, words: DataFrame, weight: float = 0.6) -> DataFrame:
    """(topic, token, relevance, lift)"""
    joined = topic_word.where("p > 0").join(words.select("token", F.col("p").alias("pw")), "token")
    lift = F.col("p") / F.col("pw")
    return joined.select("topic", "token", (weight * F.log("p") + (1 - weight) * F.log(lift)).alias("relevance"), lift.alias("lift"))


def distinctiveness(topic_word: DataFrame, topics: DataFrame) -> DataFrame:
    """(token, weight): divergence of p(t|w) under even topics from p(t)."""
    given = topics_of_words(topic_word).join(topics.select("topic", F.col("p").alias("pt")), "topic")
    return given.groupBy("token").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.col("pt"))).otherwise(0.0)).alias("weight"))


def saliency(words: DataFrame, distinct: DataFrame) -> DataFrame:
    """(token, saliency)"""
    return words.join(distinct, "token").select("token", (F.col("p") * F.col("weight")).alias("saliency"))


def prominence(given: DataFrame, n_topics: int = 100, missing: float = 1e-5) -> DataFrame:
    """(token, weight) of sparse (token, topic, p): divergence in bits from even topics, missing topics counted at `missing`, scaled to 0..1.

    Missing topics add one term times their number, so nothing is filled in.
    """
    even = 1.0 / n_topics
    rest = missing * math.log2(missing / even)
    present = F.sum(F.col("p") * (F.log2("p") - math.log2(even)))
    raw = given.where("p > 0").groupBy("token").agg((present + (n_topics - F.count("*")) * rest).alias("weight"))
    from lexmill.operators.terms import min_max

    return min_max(raw)


def top_words(topic_word: DataFrame, n: int = 10, value: str = "p") -> DataFrame:
    """(topic, rank, token, value) with ties in the tokens' order."""
    order = Window.partitionBy("topic").orderBy(F.desc(F.round(value, 12)), "token")
    return topic_word.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("topic", "rank", "token", value)


def clusters(doc_topic: DataFrame) -> DataFrame:
    """(doc_id, topic, p): each document's likeliest topic, of equal ones the smallest."""
    best = doc_topic.groupBy("doc_id").agg(F.max(F.struct(F.round("p", 12).alias("r"), F.col("p"))).alias("m"))
    same = doc_topic.join(best, "doc_id").where(F.round("p", 12) == F.col("m.r"))
    return same.groupBy("doc_id").agg(F.min("topic").alias("topic"), F.max("p").alias("p"))


# -- models ----------------------------------------------------------------------------------


def vectors(bow: DataFrame, size: int) -> DataFrame:
    """(doc_id, features): sparse vectors of (doc_id, token_id, cnt).

    A document's pairs are gathered as numbers and go through Arrow as they are: no Python rows.
    """
    pair = F.struct(F.col("token_id").cast("int").alias("i"), F.col("cnt").cast("double").alias("v"))
    listed = bow.groupBy("doc_id").agg(F.sort_array(F.collect_list(pair)).alias("x"))
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform("x", lambda x: x["i"]).alias("indices"), F.transform("x", lambda x: x["v"]).alias("values"))
    schema = T.StructType([bow.schema["doc_id"], T.StructField("features", VectorUDT())])
    return listed.select("doc_id", parts.alias("features")).mapInArrow(lambda batches: batches, schema)


def _raised(x, step: Callable, far: Callable) -> np.ndarray:
    """A function of the gamma family: step's terms up to x + 8, then the series."""
    x, out = np.asarray(x, np.float64), 0.0
    for k in range(8):
        out = out + step(x + k)
    return far(x + 8) - out


def digamma(x) -> np.ndarray:
    return _raised(x, lambda x: 1 / x, lambda x: np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8))


def log_gamma(x) -> np.ndarray:
    return _raised(x, np.log, lambda x: (x - 0.5) * np.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7))


class TopicModel:
    """LDA over vectors with a fit-transform interface; a trained model is not trained twice."""

    def __init__(self, num_topics: int = 100, passes: int = 1, chunk_share: float = 0.05, iterations: int = 50, decay: float = 0.51, offset: float = 1024.0, alpha: float | None = None, eta: float | None = None, seed: int | None = None):
        self.options = {"k": num_topics, "maxIter": max(1, round(passes / chunk_share)) if passes else iterations, "optimizer": "online", "subsamplingRate": chunk_share, "learningDecay": decay, "learningOffset": offset}
        self.alpha, self.eta, self.seed = alpha, eta, seed
        self.model: LDAModel | None = None

    def fit(self, features: DataFrame) -> TopicModel:
        if self.model is not None:
            raise RuntimeError("the model is already trained")
        lda = LDA(featuresCol="features", **self.options)
        if self.alpha is not None:
            lda = lda.setDocConcentration([self.alpha] * self.options["k"])
        if self.eta is not None:
            lda = lda.setTopicConcentration(self.eta)
        if self.seed is not None:
            lda = lda.setSeed(self.seed)
        self.model = lda.fit(features)
        return self

    def partial_fit(self, features: DataFrame, before: DataFrame) -> TopicModel:
        """Spark's LDA can't go on from a model: it is trained anew on the union."""
        self.model = None
        return self.fit(before.unionByName(features))

    def _trained(self) -> LDAModel:
        if self.model is None:
            raise RuntimeError("the model is not trained")
        return self.model

    def transform(self, features: DataFrame) -> DataFrame:
        """(doc_id, topic, p)"""
        found = self._trained().transform(features).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p"))
        return found

    def fit_transform(self, features: DataFrame) -> DataFrame:
        return self.fit(features).transform(features)

    def topic_word(self, vocab: DataFrame) -> DataFrame:
        """(topic, token, p) with p summing to 1 for each topic; a row of the model's own table holds a topic's whole vocabulary, which is bounded."""
        model = self._trained()
        described = model.describeTopics(model.vocabSize()).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("x"))
        return described.join(vocab, F.col("x.termIndices") == F.col("token_id")).select("topic", "token", F.col("x.termWeights").alias("p"))

    def _bound(self, features: DataFrame) -> tuple[float, float]:
        """The lower bound of the documents' log likelihood, and the number of their tokens.

        Spark's own sum takes exponentials of the whole topics x vocabulary table anew for
        each document; here a document reads the rows of its own words. Its variational
        parameters are its topic distribution times their sum, the prior's plus its tokens.
        """
        model = self._trained()
        lam = model.topicsMatrix().toArray()  # vocabulary x topics
        alpha = model.estimatedDocConcentration().toArray()
        eta = model.getTopicConcentration() if model.isSet(model.topicConcentration) else 1 / lam.shape[1]
        log_beta = digamma(lam) - digamma(lam.sum(axis=0))
        shared = features.sparkSession.sparkContext.broadcast(log_beta)  # bounded by the vocabulary's limit

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for part in batches.pieces(batch, batches.lengths(batch.column(0))):
                    n = batches.lengths(part.column(0))
                    row = np.repeat(np.arange(len(n)), n)
                    word, count = (batches.flat(part.column(c)).to_numpy(zero_copy_only=False) for c in (0, 1))
                    tokens = np.bincount(row, count, len(n))
                    gamma = batches.flat(part.column(2)).to_numpy(zero_copy_only=False).reshape(len(n), -1) * (alpha.sum() + tokens)[:, None]
                    log_theta = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
                    terms = log_theta[row] + shared.value[word]
                    top = terms.max(axis=1)
                    total = float((count * (top + np.log(np.exp(terms - top[:, None]).sum(axis=1)))).sum())
                    total += float(((alpha - gamma) * log_theta + log_gamma(gamma) - log_gamma(alpha)).sum() + (log_gamma(alpha.sum()) - log_gamma(gamma.sum(axis=1))).sum())
                    yield pa.RecordBatch.from_pydict({"bound": [total], "tokens": [float(tokens.sum())]})

        found = model.transform(features).select(F.unwrap_udt("features").alias("v"), vector_to_array("topicDistribution").alias("p"))
        # dense vectors hold their values only
        places = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.size("v.values") - 1))
        held = F.filter(F.arrays_zip(places.alias("i"), F.col("v.values").alias("c")), lambda x: x["c"] != 0)
        found = found.select(held.alias("h"), "p").where(F.size("h") > 0).select(F.transform("h", lambda x: x["i"]).alias("i"), F.transform("h", lambda x: x["c"]).alias("c"), "p")
        sums = found.mapInArrow(run, "bound double, tokens double").agg(F.sum("bound").alias("b"), F.sum("tokens").alias("n")).first()
        topics = ((eta - lam) * log_beta + log_gamma(lam) - log_gamma(eta)).sum() + (log_gamma(eta * len(lam)) - log_gamma(lam.sum(axis=0))).sum()
        return (sums.b or 0.0) + float(topics), sums.n or 0.0

    def score(self, features: DataFrame) -> float:
        """The documents' log likelihood under the model (a lower bound)."""
        return self._bound(features)[0]

    def log_perplexity(self, features: DataFrame) -> float:
        bound, tokens = self._bound(features)
        return -bound / tokens if tokens else math.nan

    def save(self, path: str) -> None:
        self._trained().write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> TopicModel:
        from pyspark.ml.clustering import LocalLDAModel

        out = cls()
        out.model = LocalLDAModel.load(path)
        return out
