"""The analyzer over documents that arrive as a stream: a stateless projection, the same plan as for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmill.plans.corpus import tokenized
from lexmill.sources.corpus import RAW


def read_stream(spark: SparkSession, path: str, schema: str = RAW, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def analyze_stream(docs: DataFrame, path: str, checkpoint: str, columns: tuple[str, ...] = ("text",), once: bool = True) -> StreamingQuery:
    """Writes the documents with their tokens as Parquet; after a failure it goes on from the checkpoint without loss or repetition."""
    writer = tokenized(docs, columns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
