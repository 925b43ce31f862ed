"""The folder that driver and executors share: tables that several steps read, and cuts of long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder is set only where the session has none and all runs in one process (local tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return top


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that no other table has."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, computed once and read again; it outlives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
