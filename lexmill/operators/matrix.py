"""Sparse matrices as long tables (row, col, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, v) of a times b: one join on the inner index and one sum."""
    right = b.select(F.col("row").alias("__k"), F.col("col").alias("__c"), F.col("v").alias("__v"))
    return a.join(right, F.col("col") == F.col("__k")).groupBy("row", F.col("__c").alias("col")).agg(F.sum(F.col("v") * F.col("__v")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("row").agg(F.sum("v").alias("v"))


def normalized(a: DataFrame) -> DataFrame:
    """Rows that sum to 1; rows that sum to 0 stay as they are."""
    total = row_sums(a).withColumnRenamed("v", "__t")
    return a.join(total, "row").select("row", "col", F.when(F.col("__t") != 0, F.col("v") / F.col("__t")).otherwise(F.col("v")).alias("v"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, a, b): cells of either matrix, 0 where the other has none."""
    left, right = a.select("row", "col", F.col("v").alias("a")), b.select("row", "col", F.col("v").alias("b"))
    return left.join(right, ["row", "col"], "full_outer").select("row", "col", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
