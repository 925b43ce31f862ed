"""Keywords, sentence ranks and summaries by TextRank: each document is one row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.clean import clean, strip
from lexmill.functions.split import sentences
from lexmill.functions.tokens import filter_tokens, kept_words, tokenize
from lexmill.operators import batches
from lexmill.operators.graph import SentenceGraphs, keyword_scores, map_rows

_SCORED = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("score", T.DoubleType())]))


def keywords(docs: DataFrame, top_n: int | None = 10, window: int = 4, max_iter: int = 200, min_diff: float = 0.001, script: str | None = "letters", text: str = "text", cleaned: bool = True, filtered: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The documents with keywords: (item, score), the best top_n first."""
    tokens = tokenize(clean(F.col(text)) if cleaned else F.col(text))
    df = docs.withColumn("__tokens", filter_tokens(tokens, script=script) if filtered else tokens)

    def make():
        def f(tokens: list | None):
            scored = keyword_scores(tokens or [], window, max_iter=max_iter, min_diff=min_diff)
            return ([{"item": t, "score": s} for t, s in scored[:top_n]],)

        return f

    return map_rows(df, "__tokens", [T.StructField("keywords", _SCORED)], make, [c for c in (docs.columns if keep is None else keep)])


def _ranked(docs: DataFrame, criterion: str, script: str | None, text: str, cleaned: bool, keep: list[str], fields: list[T.StructField], result: Callable, **rule) -> DataFrame:
    """The documents with result's arrays of each document's number of sentences, the scores, the ranks and the sentences.

    Words are filtered once for a batch of documents, whose graphs are ranked together.
    """
    source = clean(F.col(text)) if cleaned else F.col(text)
    df = docs.withColumn("__sents", F.filter(F.transform(sentences(source, criterion), strip), lambda s: s != ""))

    def found(per_doc: np.ndarray, per_sent: np.ndarray, words: pa.Array, sents: pa.Array):
        code, distinct = batches.encoded(words)
        kept = kept_words(distinct, script)[code] if len(code) else np.zeros(0, bool)
        sent = np.repeat(np.arange(len(per_sent)), per_sent)[kept]
        graphs = SentenceGraphs(per_doc, np.bincount(sent, minlength=len(per_sent)), code[kept])
        return None, result(per_doc, *graphs.rank(**rule), batches.flat(sents))

    return batches.map_sentences(df, keep, F.transform("__sents", lambda s: tokenize(s)), fields, found, F.col("__sents"))


def sentence_ranks(docs: DataFrame, criterion: str = "coarse", max_iter: int = 200, min_diff: float = 0.001, script: str | None = "letters", text: str = "text", cleaned: bool = True, keep: list[str] | None = None, signed: bool = False) -> DataFrame:
    """The documents with scores (one for each sentence) and ranks (sentence numbers, the best first). signed is the graph's rule to stop."""
    fields = [T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("ranks", T.ArrayType(T.LongType()))]
    result = lambda per_doc, s, order, _: [batches.listed(per_doc, pa.array(s)), batches.listed(per_doc, pa.array(order))]
    return _ranked(docs, criterion, script, text, cleaned, docs.columns if keep is None else keep, fields, result, max_iter=max_iter, min_diff=min_diff, signed=signed)


def summarize(docs: DataFrame, n_sentences: int = 5, criterion: str = "coarse", max_iter: int = 200, min_diff: float = 0.001, script: str | None = "letters", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with summary: the best sentences in the order of their rank, without a separator."""

    def result(per_doc: np.ndarray, _, order: np.ndarray, sents: pa.Array):
        first = np.cumsum(per_doc) - per_doc
        many = np.array([len(range(n)[:n_sentences]) for n in per_doc.tolist()], np.int64)
        best = (np.arange(len(order)) - np.repeat(first, per_doc)) < np.repeat(many, per_doc)
        chosen = sents.take(pa.array((order + np.repeat(first, per_doc))[best]))
        return [pc.binary_join(batches.listed(many, chosen), "")]

    return _ranked(docs, criterion, script, text, True, docs.columns if keep is None else keep, [T.StructField("summary", T.StringType())], result, max_iter=max_iter, min_diff=min_diff)


def bm25_document_weights(docs: DataFrame, sents: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """`bm25_sentence_weights` of documents with their sentences' tokens, an array of arrays: where each row has a doc_id of its own, nothing is shuffled."""
    if not batches.one_row_each(docs):
        rows = docs.select("doc_id", F.posexplode(sents).alias("idx", "tokens"))
        return bm25_sentence_weights(rows.withColumn("idx", F.col("idx").cast("long")), k1, b)
    fields = [T.StructField("idx", T.LongType()), T.StructField("weight", T.DoubleType())]

    def found(per_doc: np.ndarray, per_sent: np.ndarray, words: pa.Array):
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        idx, some = np.arange(len(per_sent)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc), per_sent > 0
        graphs = SentenceGraphs(np.bincount(doc[some], minlength=len(per_doc)), per_sent[some], batches.encoded(words)[0], k1, b)
        return doc[some], [pa.array(idx[some]), pa.array(graphs.times(np.ones(graphs.n)))]

    return batches.map_sentences(docs, ["doc_id"], sents, fields, found)


def bm25_sentence_weights(sents: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, idx, weight): each sentence's weights to the others of its document, summed; sents is (doc_id, idx, tokens).

    For each word and number of occurrences the sentences that have it so often are
    counted once; pairs of sentences are never made.
    """
    sents = sents.where(F.size("tokens") > 0)
    sizes = sents.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    tf = sents.select("doc_id", "idx", F.size("tokens").alias("len"), F.explode("tokens").alias("token")).groupBy("doc_id", "idx", "len", "token").agg(F.count("*").alias("c"))
    classes = tf.groupBy("doc_id", "token", "c").agg(F.count("*").alias("many"))
    words = classes.groupBy("doc_id", "token").agg(F.sum("many").alias("df"), F.collect_list(F.struct("c", "many")).alias("classes"))
    joined = tf.join(words, ["doc_id", "token"]).join(sizes, "doc_id")
    big_k = k1 * (1 - b + b * F.col("len") / F.col("mean"))
    share = lambda f: f * (k1 + 1) / (f + F.col("k"))
    others = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x["many"] * share(x["c"])) - share(F.col("c"))
    weight = F.col("c") * (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * others
    return joined.withColumn("k", big_k).groupBy("doc_id", "idx").agg(F.sum(weight).alias("weight"))
