"""Readers and writers of corpora, vocabularies, sparse matrices, weights and mining tables.

Writers replace what is there. Paths go to Spark's own readers and writers, so any file
system will do.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.dataset import row_index

RAW = "id long, title string, text string, label string"


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """One JSON object a line, with a declared schema: the data are read once."""
    return spark.read.schema(schema).json(path)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The table dealt over the cores where its files give fewer scan tasks than that; a large table stays as it is read.

    A small file of one row group would else be one task's work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def read_many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several datasets as one, in their order."""
    return reduce(DataFrame.unionByName, [read_dataset(spark, p, schema) for p in paths])


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Tab-separated lines: id, token, document frequency."""
    vocab.select("token_id", "token", "df").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id long, token string, df long").option("sep", "\t").option("quote", "").csv(path)


def write_matrix_market(bow: DataFrame, path: str, value: str = "cnt") -> None:
    """A folder of Matrix Market text: `header` holds the two head lines, `entries` lines of row, column (from 1) and value."""
    size = bow.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("r"), F.coalesce(F.max("token_id") + 1, F.lit(0)).alias("c"), F.count("*").alias("n"))
    head = size.select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate real general"), F.concat_ws(" ", "r", "c", "n"))).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    bow.select(F.concat_ws(" ", F.col("doc_id") + 1, F.col("token_id") + 1, F.col(value).cast("double").cast("string"))).write.mode("overwrite").text(f"{path}/entries")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, token_id, weight) from such a folder, or from a plain file with comments and a size line."""
    try:
        lines = spark.read.text(f"{path}/entries")
        lines.schema  # noqa: B018
        sized = False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines, sized = spark.read.text(path), True
    parts = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    if sized:  # the size line holds whole numbers, the last of them the number of entries
        head = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != "")).first()
        parts = parts.where(F.array_join("p", " ") != " ".join(head.value.split()))
    return parts.select((F.col("p")[0].cast("long") - 1).alias("doc_id"), (F.col("p")[1].cast("long") - 1).alias("token_id"), F.col("p")[2].cast("double").alias("weight"))


def write_svmlight(bow: DataFrame, path: str, value: str = "cnt") -> None:
    """A line for each document: 0 and index:value pairs from 1 in ascending order."""
    rows = bow.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_id", F.col(value).cast("double").alias("v")))).alias("x"))
    line = F.concat_ws(" ", F.lit("0"), F.array_join(F.transform("x", lambda x: F.concat_ws(":", (x["token_id"] + 1).cast("string"), x["v"].cast("string"))), " "))
    rows.select(line).write.mode("overwrite").text(path)


def read_svmlight(spark: SparkSession, path: str, size: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", size).load(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(place, token, weight) of one JSON object in a file, or in files one after the other; place is the token's, from 0.

    Lines are read apart where each holds whole entries, as `write_weight_object` writes them;
    an object that is broken elsewhere is read as one text.
    """
    # the place of a line: its file, its block of the file, its number
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("l"))
    inner = F.regexp_replace("value", r"^\s*[{,]?\s*|\s*[,}]?\s*$", "")
    lines = lines.withColumn("value", inner).where("value <> ''").withColumn("m", F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,double>", {"mode": "PERMISSIVE"}))
    if not lines.where("m is null").isEmpty():
        parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
        return parsed.select(F.posexplode("m").alias("place", "token", "weight"))
    entries = lines.select("f", "b", "l", F.posexplode("m").alias("e", "token", "weight"))
    return row_index(entries, ["f", "b", "l", "e"], "place").select("place", "token", "weight")


def write_weights(weights: DataFrame, path: str) -> None:
    """Lines of JSON objects {token, weight}, by falling weight in each file; no task needs the whole table."""
    weights.select("token", "weight").repartitionByRange("weight", "token").sortWithinPartitions("weight", "token").write.mode("overwrite").json(path)


def write_weight_object(weights: DataFrame, path: str) -> None:
    """One JSON object from token to weight, by rising weight (ties by token), an entry a line: the files one after the other are the object, so no task needs the whole table."""
    placed = row_index(weights.select("token", "weight"), ["weight", "token"], "place")
    n = placed.count()
    if not n:
        placed.sparkSession.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(path)
        return
    entry = F.regexp_replace(F.to_json(F.create_map("token", "weight")), r"^\{|\}$", "")
    line = F.concat(F.when(F.col("place") == 0, "{").otherwise(","), entry, F.when(F.col("place") == n - 1, "}").otherwise(""))
    placed.repartitionByRange("place").sortWithinPartitions("place").select(line.alias("value")).write.mode("overwrite").text(path)


def read_weight_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, weight double").json(path)


MINING = ("topic_word", "doc_topic", "lengths")


def write_mining(path: str, topic_word: DataFrame, doc_topic: DataFrame, lengths: DataFrame) -> None:
    for name, df in zip(MINING, (topic_word, doc_topic, lengths), strict=True):
        write_dataset(df, f"{path}/{name}")


def read_mining(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: read_dataset(spark, f"{path}/{name}") for name in MINING}


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between a page's url and each of its hrefs, both ways, with their number."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    out = pages.select(F.concat(F.lit("page:"), "url").alias("src"), href.alias("h")).select("src", F.concat(F.lit("href:"), "h").alias("dst"))
    both = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def log_to(path: str | None = None, name: str = "lexmill") -> logging.Logger:
    """A logger to standard error, and to a new file if a path is given."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    for h in list(log.handlers):
        log.removeHandler(h)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path, mode="w", encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
