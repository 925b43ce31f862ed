"""From raw documents to a topic model and weight tables, each step a table that is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.clean import strip
from lexmill.functions.tokens import analyze
from lexmill.operators import terms, topics
from lexmill.sources import corpus


def tokenized(docs: DataFrame, columns: tuple[str, ...] = ("text",), script: str | None = "letters") -> DataFrame:
    """The documents with tokens: those of the columns one after the other, and `<column>_tokens` for each."""
    out = docs
    for c in columns:
        out = out.withColumn(f"{c}_tokens", analyze(strip(F.coalesce(F.col(c), F.lit(""))), script=script))
    return out.withColumn("tokens", F.concat(*[F.col(f"{c}_tokens") for c in columns]))


def build(spark: SparkSession, docs: DataFrame, path: str, num_topics: int = 15, no_below: int = 5, no_above: float = 0.5, keep_n: int = 100_000, seed: int = 0, columns: tuple[str, ...] = ("text",), **options) -> topics.TopicModel:
    """Writes dataset, vocabulary, bag of words, model, mining tables and weights under path."""
    corpus.write_dataset(tokenized(docs, columns).select("doc_id", "tokens"), f"{path}/dataset")
    data = corpus.read_dataset(spark, f"{path}/dataset")
    corpus.write_dataset(terms.term_frequency(terms.explode_tokens(data, F.col("tokens"), "doc_id")), f"{path}/tf")
    tf, n = corpus.read_dataset(spark, f"{path}/tf"), data.count()
    df = terms.document_frequency(tf)
    corpus.write_vocabulary(terms.vocabulary(df, n, no_below, no_above, keep_n), f"{path}/vocabulary")
    vocab = corpus.read_vocabulary(spark, f"{path}/vocabulary")
    corpus.write_dataset(terms.bag_of_words(tf, vocab), f"{path}/bow")
    bow = corpus.read_dataset(spark, f"{path}/bow")
    corpus.write_dataset(topics.vectors(bow, vocab.count()), f"{path}/vectors")
    features = corpus.read_dataset(spark, f"{path}/vectors")
    model = topics.TopicModel(num_topics, seed=seed, **options).fit(features)
    model.save(f"{path}/model")
    corpus.write_mining(f"{path}/mining", model.topic_word(vocab), model.transform(features), terms.doc_lengths(bow))
    mined = corpus.read_mining(spark, f"{path}/mining")
    marginal = topics.topic_marginals(mined["doc_topic"], mined["lengths"])
    corpus.write_weights(terms.min_max(topics.distinctiveness(mined["topic_word"], marginal)), f"{path}/word_weights")
    corpus.write_weights(terms.idf(df, n), f"{path}/idf")
    return model


def sweep(spark: SparkSession, docs: DataFrame, path: str, counts: tuple[int, ...] = (15, 50), **options) -> dict[int, topics.TopicModel]:
    """A model for each number of topics."""
    return {k: build(spark, docs, f"{path}/k{k}", k, **options) for k in counts}
