"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents. A stage works on all that the
one before it kept, and its decisions take effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import shared_dir, written
from lexmill.llm.decontam import decontaminate
from lexmill.llm.line_dedup import dedup_lines
from lexmill.llm.near_copies import near_copies as similar
from lexmill.llm.pieces import encode
from lexmill.llm.quality_classifier import classify


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classify(docs, _table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in documents of smaller ids; n_chars follows the text."""
    cleaned = dedup_lines(docs)
    if "n_chars" in docs.columns:
        same = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(same)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash by BK-trees, confirmed by exact comparison, and the exact way beyond its radius link (five-word Jaccard similarity of 0.8 or more): that of the smallest id (of rows that share it, or of a group without ids, the row whose text has the smallest hash)."""
    hashed = F.xxhash64("text")
    found = written(similar(docs.select("doc_id", "text", hashed.alias("__h")), keep=["doc_id", "__h"]), "groups")  # decisions go by hashes; texts move once, at the end
    # of each group the smallest id, then the smallest hash of a text; ids come before rows without one
    best = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")).alias("x"))
    best = best.select("x.doc_id", "x.__h")
    # -1 can't stand for a missing id alone, so a flag goes with it
    keys = [F.coalesce("doc_id", F.lit(-1).cast("long")).alias("__d"), F.col("doc_id").isNull().alias("__null"), "__h"]
    stay = best.select(F.col("doc_id").cast("long").alias("doc_id"), "__h").select(*keys)
    # equal rows meet in the tasks that read them, then once by key, where the join needs them too; maps can't be compared, so hashes of the other columns choose
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("__d"), F.col("doc_id").isNull().alias("__null"), hashed.alias("__h"), row.alias("__row"), plain.alias("__plain"))
    rows = rows.groupBy("__d", "__null", "__h").agg(F.min_by("__row", "__plain").alias("__row"))
    return rows.join(stay, ["__d", "__null", "__h"], "left_semi").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces."""
    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("tokens", tokens)]
#: The classifier, the near-duplicate components and the pieces can't be expressed in SQL: tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents."""
    docs, top = _table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
