"""Information theory over observed distributions; 0 log 0 is 0. Logarithms are natural."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n, p)"""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("__t")).drop("__t")


def plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def information(p: Column) -> Column:
    return -F.log(p)


def odds(p: Column) -> Column:
    return p / (1 - p)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def entropy(df: DataFrame, *columns: str) -> DataFrame:
    """One row (entropy)."""
    return distribution(df, *columns).agg(F.sum(plogp(F.col("p"))).alias("entropy"))


def joint(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n, p, px, py): joint and marginal probabilities; the groups are distinct values, not rows."""
    d = distribution(df.select(F.col(x).alias("x"), F.col(y).alias("y")), "x", "y")
    px = d.groupBy(F.col("x").alias("x1")).agg(F.sum("p").alias("px"))
    py = d.groupBy(F.col("y").alias("y1")).agg(F.sum("p").alias("py"))
    return d.join(px, F.col("x").eqNullSafe(F.col("x1"))).join(py, F.col("y").eqNullSafe(F.col("y1"))).select("x", "y", "n", "p", "px", "py")


def joint_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: entropies of x, of y and of both, y given x, mutual information and its normal form."""
    j = joint(df, x, y)
    h = j.agg(F.sum(plogp(F.col("p"))).alias("h_xy"), F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), F.sum(-F.col("p") * F.log("px")).alias("h_x"), F.sum(-F.col("p") * F.log("py")).alias("h_y"))
    return h.select("h_x", "h_y", "h_xy", (F.col("h_xy") - F.col("h_x")).alias("h_y_given_x"), "mi", F.when(F.col("h_xy") > 0, F.col("mi") / F.col("h_xy")).otherwise(0.0).alias("nmi"))


def bayes(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, p, px, py, y_given_x, x_given_y)"""
    j = joint(df, x, y)
    return j.select("x", "y", "p", "px", "py", (F.col("p") / F.col("px")).alias("y_given_x"), (F.col("p") / F.col("py")).alias("x_given_y"))


def smoothed_pair(a: DataFrame, b: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(key, p, q): two distributions (key, p) over the keys of either, missing ones `least`."""
    q = b.select(F.col(key), F.col("p").alias("q"))
    return a.select(key, "p").join(q, key, "full_outer").select(key, F.coalesce("p", F.lit(least)).alias("p"), F.coalesce("q", F.lit(least)).alias("q"))


def divergence(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)


def divergences(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, kl, cross_entropy, js) of tables (p, q); infinite where q lacks what p has."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    infinite = F.max(F.when((p > 0) & (q <= 0), True).otherwise(False))
    safe = F.when(q > 0, divergence(p, q)).otherwise(0.0)
    cross = F.when((p > 0) & (q > 0), -p * F.log(q)).otherwise(0.0)
    found = pairs.groupBy(*keys).agg(infinite.alias("__inf"), F.sum(safe).alias("__kl"), F.sum(cross).alias("__ce"), F.sum((divergence(p, m) + divergence(q, m)) / 2).alias("js"))
    inf = lambda c: F.when(F.col("__inf"), F.lit(float("inf"))).otherwise(F.col(c))
    return found.select(*keys, inf("__kl").alias("kl"), inf("__ce").alias("cross_entropy"), "js")


def pointwise(pairs: DataFrame) -> DataFrame:
    """A table with p, px and py, and pmi and npmi beside them."""
    pmi = F.log(F.col("p") / (F.col("px") * F.col("py")))
    return pairs.withColumn("pmi", pmi).withColumn("npmi", F.when(F.col("p") < 1, pmi / -F.log("p")).otherwise(1.0))


def with_total(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The table with `total`, the sum of the value over the keys."""
    return df.withColumn("total", F.sum(value).over(Window.partitionBy(*keys)))
