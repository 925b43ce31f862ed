"""Weights of words for documents that stay one row: each document's distinct words are looked up once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.terms import upper_median
from lexmill.plans.storage import cut


def unknown_weights(idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None) -> tuple[float, float]:
    """Weights of words that a table lacks: the given ones, else the upper median of the idf weights and half the mean of the prominence weights (0 for empty tables)."""
    if unknown_idf is None:
        row = upper_median(idf).first()
        unknown_idf = float(row.upper_median or 0.0) if row else 0.0
    if unknown_prominence is None:
        unknown_prominence = float(prominence.agg(F.avg("weight") / 2).first()[0] or 0.0)
    return unknown_idf, unknown_prominence


def weight_table(idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None) -> tuple[DataFrame, float, float]:
    """(token, idf, topic) of the words of either table, and the weights of other words."""
    own_idf, own_topic = unknown_weights(idf, prominence, unknown_idf, unknown_prominence)
    both = idf.select("token", F.col("weight").alias("idf")).join(prominence.select("token", F.col("weight").alias("topic")), "token", "full_outer")
    return both.select("token", F.coalesce("idf", F.lit(own_idf)).alias("idf"), F.coalesce("topic", F.lit(own_topic)).alias("topic")), own_idf, own_topic


COMMON, LONGEST = 100_000, 64


class Common:
    """The words of a weight table that most tokens are: the COMMON of least idf, without those of more than LONGEST characters, which bounds what is broadcast.

    Which words these are decides no result: the others are looked up by a join.
    """

    def __init__(self, table: DataFrame, most: int = COMMON):
        short, n = table.where(F.length("token") <= LONGEST), table.count()
        if n > most:  # few rows but the least go into the sort that ends in one task
            short = short.where(F.col("idf") <= short.approxQuantile("idf", [most / n], 0.001)[0])
        found = short.orderBy("idf", "token").limit(most).toArrow().combine_chunks()
        column = lambda c: found.column(c).to_numpy()
        self.shared = table.sparkSession.sparkContext.broadcast((found.column("token").to_pylist(), column("idf").copy(), column("topic").copy()))

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is there, its idf and its topic weight (else 0)."""
        tokens, idf, topic = self.shared.value
        at = pc.fill_null(pc.index_in(words, value_set=pa.array(tokens, words.type)), -1).to_numpy(zero_copy_only=False)
        there = at >= 0
        return there, np.append(idf, 0.0)[at], np.append(topic, 0.0)[at]


def with_words(rows: DataFrame, tokens: Column, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, **more: Column) -> DataFrame:
    """The rows with words: (token, idf, topic) of each of their distinct tokens, and more as columns of `token`.

    The rows are written once with a number; only numbers and distinct words meet the weights.
    """
    table, own_idf, own_topic = weight_table(idf, prominence, unknown_idf, unknown_prominence)
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = rows.select("__row", F.explode(F.array_distinct(tokens)).alias("token")).join(table, "token", "left")
    word = F.struct("token", F.coalesce("idf", F.lit(own_idf)).alias("idf"), F.coalesce("topic", F.lit(own_topic)).alias("topic"), *[c.alias(n) for n, c in more.items()])
    return rows.join(found.groupBy("__row").agg(F.collect_list(word).alias("words")), "__row", "left").drop("__row")
