"""What the operators share: the shared folder, word patterns, and Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python function works on at once; one text may be longer.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting and all runs in one process (local tests) a
    temporary folder is set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/lexmill-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


@contextmanager
def no_gc() -> Iterator[None]:
    """Without the search for reference cycles, which goes through all words that a worker remembers; they form none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """Each row's kept columns, and the fields that make()'s function finds in the texts.

    The function gets a list of bytes (None for null) and returns a pyarrow array for
    each field. A field replaces an input column of its name.
    """
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                with no_gc():
                    found = f(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[*kept, *names])

    return source.mapInArrow(run, schema)
