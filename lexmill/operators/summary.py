"""Extractive summaries by topic prominence, TF-IDF, length and place of sentences, under a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions.clean import clean
from lexmill.functions.split import sentences
from lexmill.functions.tokens import SCRIPTS, tokenize
from lexmill.operators import batches
from lexmill.operators.graph import map_rows
from lexmill.operators.weights import COMMON, Common, weight_table
from lexmill.plans.storage import cut


def kept_sentences(docs: DataFrame, criterion: str = "coarse", script: str = "letters", text: str = "text", cleaned: bool = True) -> DataFrame:
    """(doc_id, document, sents): the cleaned document, and those of its sentences that have the script as (sentence, tokens)."""
    source = clean(F.col(text)) if cleaned else F.col(text)
    df = docs.select("doc_id", source.alias("document"))
    kept = F.filter(sentences(F.col("document"), criterion), lambda s: s.rlike(SCRIPTS[script]))
    return df.select("doc_id", "document", F.transform(kept, lambda s: F.struct(s.alias("sentence"), tokenize(s).alias("tokens"))).alias("sents"))


def taken(found: list[tuple[str, float]], budget: int, digits: int = 9) -> tuple[str, int]:
    """The summary of one document's (sentence, weight), and its number of sentences: see `greedy`."""
    order, chosen, used = sorted(range(len(found)), key=lambda i: (-round(found[i][1], digits), -i)), [], 0
    for i in order:
        used += len(found[i][0])
        if used > budget:
            break
        chosen.append(i)
        if i == len(found) - 1:
            break
    return "".join(found[i][0] for i in sorted(chosen)) if chosen else found[order[0]][0][:budget] if order else "", len(chosen)


def _parts(sents: DataFrame, common: Common, theta: float, lead: float) -> DataFrame:
    """`kept_sentences` with sentences, and for each the sum of its common words' weights (base) and what the sum is multiplied by (factor); rest: each other word of a sentence, with its count there and its share of the document's tokens."""
    doubles = T.ArrayType(T.DoubleType())
    word = T.StructType([T.StructField("token", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("share", T.DoubleType())])
    fields = [T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("base", doubles), T.StructField("factor", doubles), T.StructField("rest", T.ArrayType(word))]

    def found(per_doc: np.ndarray, per_sent: np.ndarray, words: pa.Array, sentences: pa.Array):
        n, texts = len(per_sent), batches.flat(sentences)
        idx = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        doc, sent = np.repeat(np.arange(len(per_doc)), per_doc), np.repeat(np.arange(n), per_sent)
        code, distinct = batches.encoded(words)
        v = max(len(distinct), 1)
        key, at, tf = np.unique(doc[sent] * v + code, return_inverse=True, return_counts=True)
        share = tf[at] / np.maximum(np.bincount(doc[sent], minlength=len(per_doc)), 1)[doc[sent]]
        there, idf, topic = common.find(distinct)
        base = np.bincount(sent, topic[code] * theta + share * idf[code], n)
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        factor = np.where((size >= 15) & (size <= 70), 1.0, 0.7) * np.where(idx < 3, lead, 1.0) / np.maximum(per_sent, 1)
        other = ~there[code]
        key, first, c = np.unique(sent[other] * v + code[other], return_index=True, return_counts=True)
        at = key // v
        rest = pa.StructArray.from_arrays([distinct.take(pa.array(key % v)), pa.array(idx[at].astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(share[other][first])], fields=list(to_arrow_type(word)))
        each = np.bincount(doc[at], minlength=len(per_doc))
        return None, [batches.listed(per_doc, texts), batches.listed(per_doc, pa.array(base)), batches.listed(per_doc, pa.array(factor)), batches.listed(each, rest)]

    own = lambda name: F.transform("sents", lambda x: x[name])
    return batches.map_sentences(sents, ["doc_id", "document"], own("tokens"), fields, found, own("sentence"))


def document_weights(sents: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, theta: float = 0.2, lead: float = 1.2, keep: Sequence[str] = ("doc_id", "document", "sentences"), most: int = COMMON) -> DataFrame:
    """The columns `keep` of `kept_sentences`, and weights: those of `sentence_weights`, a document a row.

    The `most` common words are weighed where the document is read, others by a join with the table; sums
    of these, not texts or tokens, then meet the document by its number.
    """
    if not (0 <= theta <= 1 and lead >= 1):
        raise ValueError("theta must be in 0..1 and lead at least 1")
    table, own_idf, own_topic = weight_table(idf, prominence, unknown_idf, unknown_prominence)
    table = cut(table)
    rows = sents if "document" in keep else sents.withColumn("document", F.lit(None).cast("string"))
    rows = cut(_parts(rows, Common(table, most), theta, lead).withColumn("__row", F.monotonically_increasing_id()))
    rest = rows.where(F.size("rest") > 0).select("__row", F.explode("rest").alias("x")).select("__row", "x.*").join(table, "token", "left")
    more = F.col("c") * (F.coalesce("topic", F.lit(own_topic)) * theta + F.col("share") * F.coalesce("idf", F.lit(own_idf)))
    sums = rest.select("__row", F.struct("idx", more.alias("x")).alias("x")).groupBy("__row").agg(F.sort_array(F.collect_list("x")).alias("more"))
    rows = rows.select("__row", *keep, "base", "factor").join(sums, "__row", "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            base, factor, more = (part.column(k) for k in (-3, -2, -1))
            n, each, x = batches.lengths(base), batches.lengths(more), batches.flat(more)
            total = batches.flat(base).to_numpy(zero_copy_only=False).copy()
            np.add.at(total, np.repeat(np.cumsum(n) - n, each) + x.field("idx").to_numpy(zero_copy_only=False), x.field("x").to_numpy(zero_copy_only=False))
            weights = pa.array(total * batches.flat(factor).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*part.columns[:-3], batches.listed(n, weights)], names=[*keep, "weights"])

    source = rows.select(*keep, "base", "factor", "more")
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-3], T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def sentence_weights(sents: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, theta: float = 0.2, lead: float = 1.2) -> DataFrame:
    """(doc_id, idx, sentence, weight) of `kept_sentences`; idf and prominence are (token, weight).

    weight = mean prominence * theta + mean tf * idf / tokens of the document; * 0.7 unless
    15 to 70 characters; * lead for the first three sentences. A sentence without tokens
    weighs 0. Unknown words weigh the upper median of the idf table and half the mean of the
    prominence table, unless given.
    """
    found = document_weights(sents, idf, prominence, unknown_idf, unknown_prominence, theta, lead, ["doc_id", "sentences"])
    return found.select("doc_id", F.posexplode(F.arrays_zip("sentences", "weights")).alias("idx", "x")).select("doc_id", "idx", F.col("x.sentences").alias("sentence"), "x.weights").withColumnRenamed("weights", "weight")


def chosen_sentences(sents: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, budget: int = 200, theta: float = 0.2, lead: float = 1.2) -> DataFrame:
    """(doc_id, document, n, summary, n_taken) of `kept_sentences`: the choice of `greedy` by the weights of `sentence_weights`, without a table of sentences."""
    fields = [T.StructField("summary", T.StringType()), T.StructField("n_taken", T.LongType())]
    found = document_weights(sents, idf, prominence, unknown_idf, unknown_prominence, theta, lead)
    rows = found.select("doc_id", "document", F.size("sentences").alias("n"), F.struct("sentences", "weights").alias("__in"))
    return map_rows(rows, "__in", fields, lambda: lambda v: taken(list(zip(v["sentences"] or [], v["weights"] or [], strict=True)), budget), ["doc_id", "document", "n"])


def greedy(weights: DataFrame, budget: int = 200, digits: int = 9) -> DataFrame:
    """(doc_id, summary, n_taken): sentences by falling weight while they fit, in the document's order.

    Taking stops at the first sentence that would not fit, and after the document's last
    sentence has been taken. If already the first does not fit, its prefix is the summary.
    Weights count to so many digits, so that equal ones tie on any engine.
    """
    by_rank = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", digits)), F.desc("idx"))
    whole = Window.partitionBy("doc_id")
    ranked = weights.select("doc_id", "idx", "sentence", F.row_number().over(by_rank).alias("rank"), F.sum(F.length("sentence")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.max("idx").over(whole).alias("last"))
    ranked = ranked.withColumn("stop", F.max(F.when(F.col("idx") == F.col("last"), F.col("rank"))).over(whole))
    taken = (F.col("upto") <= budget) & (F.col("rank") <= F.col("stop"))
    # only what fits the budget is gathered
    grouped = ranked.where(taken | (F.col("rank") == 1)).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(taken, F.struct("idx", "sentence")))).alias("s"), F.max(F.when(F.col("rank") == 1, F.substring("sentence", 1, budget))).alias("first")
    )
    joined = F.array_join(F.transform("s", lambda x: x["sentence"]), "")
    return grouped.select("doc_id", F.when(F.size("s") > 0, joined).otherwise(F.col("first")).alias("summary"), F.size("s").cast("long").alias("n_taken"))


def summarize(docs: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, budget: int = 200, theta: float = 0.2, lead: float = 1.2, criterion: str = "coarse", script: str = "letters", text: str = "text") -> DataFrame:
    """(doc_id, summary): a document shorter than the budget is its own summary; one with at most one sentence gives its prefix."""
    found = chosen_sentences(kept_sentences(docs, criterion, script, text), idf, prominence, unknown_idf, unknown_prominence, budget, theta, lead)
    whole = (F.length("document") < budget) | (F.col("n") <= 1)
    return found.select("doc_id", F.when(F.col("document").isNull(), None).when(whole, F.substring("document", 1, budget)).otherwise(F.col("summary")).alias("summary"))
