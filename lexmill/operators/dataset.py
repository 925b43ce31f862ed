"""Mapping functions over a dataset, row numbers, shuffles, samples and chained sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.plans.storage import cut

INDEX, SHARD = "__index", "__shard"


def _columns(df: DataFrame, names: str | Sequence[str] | None, what: str) -> list[str]:
    names = [] if names is None else [names] if isinstance(names, str) else list(names)
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} not in the dataset: {missing}; it has {df.columns}")
    return names


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order of the columns, without one task that sees all rows.

    Rows are dealt into ranges and written once with their place in their range: the
    ranges' sizes (one number for each) and the rows are read from that table, so both see
    the same ranges. Rows that tie in the order columns follow the hash of their columns
    (maps left out), which also splits a value that many rows share; equal rows get any
    order.
    """
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__tie", F.xxhash64(*hashed) if hashed else F.lit(0)).repartitionByRange(n, *by, "__tie").sortWithinPartitions(*by, "__tie")
    mono = F.monotonically_increasing_id()  # the partition, and the row's place in it in the lower 33 bits
    dealt = cut(ranged.withColumn("__mono", mono).select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("__mono", 33).alias("__part"), F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__start"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


def map_dataset(
    df: DataFrame, function: Callable | None, schema: T.StructType | str | None = None, input_columns: str | Sequence[str] | None = None, remove_columns: str | Sequence[str] | None = None,
    with_indices: bool = False, with_rank: bool = False, order: Sequence[str] | None = None, batched: bool = False, batch_size: int = 1000, drop_last_batch: bool = False, shards: int | None = None,
    fn_kwargs: dict | None = None, keep: bool = False, cache_path: str | None = None,
) -> DataFrame:
    """The dataset with the columns that the function gives for each row (dict) or batch (dict of lists).

    function None changes nothing but remove_columns. schema names the new columns. Row
    numbers are global, in the given order. shards are runs of rows in that order, whose
    numbers of rows differ by one at most; there are no more of them than rows. Without
    shards the rank is the partition. keep persists the result on memory and disk, so that
    only lost parts are computed again. cache_path keeps each shard as a partition of a
    table; a later call computes only the shards that the table lacks. The two exclude
    each other.
    """
    if shards is not None and shards <= 0:
        raise ValueError("shards must be positive")
    if keep and cache_path is not None:
        raise ValueError("keep and cache_path exclude each other")
    wanted, removed = _columns(df, input_columns, "input_columns"), _columns(df, remove_columns, "remove_columns")
    if function is None:
        return df.drop(*removed)
    if schema is None:
        raise ValueError("schema of the new columns is needed")
    new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    cut_up = shards is not None and (with_rank or cache_path is not None)
    if with_indices or cut_up:
        df = row_index(df, order or df.columns, INDEX)
    if cut_up:
        df = df.withColumn(SHARD, contiguous_shard(F.col(INDEX), df.count(), shards))
    elif with_rank:
        df = (df.repartition(shards) if shards else df).withColumn(SHARD, F.spark_partition_id())
    elif shards:
        df = df.repartitionByRange(shards, INDEX) if with_indices else df.repartition(shards)
    if cache_path is not None:
        return _cached(df if cut_up else df.withColumn(SHARD, F.lit(0)), cache_path, lambda part: _mapped(part, function, new, wanted, removed, with_indices, with_rank, batched, batch_size, drop_last_batch, fn_kwargs, SHARD))
    out = _mapped(df, function, new, wanted, removed, with_indices, with_rank, batched, batch_size, drop_last_batch, fn_kwargs)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if keep else out


def contiguous_shard(index: Column, rows: int, shards: int) -> Column:
    """The shard of a row number: the first rows mod shards of them have one row more than the others."""
    k = max(1, min(shards, rows))
    size, longer = divmod(rows, k)
    if not size:
        return F.lit(0)
    head = longer * (size + 1)
    return F.when(index < head, F.floor(index / (size + 1))).otherwise(longer + F.floor((index - head) / size)).cast("int")


def _cached(df: DataFrame, path: str, mapped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The mapped rows from the table under path, whose missing shards are computed and added first.

    Shards are found by `done`, a small table beside the rows that is written after them:
    a run that breaks off leaves no shard that counts as there.
    """
    spark, rows, done = df.sparkSession, f"{path}/rows", f"{path}/done"
    try:
        there = spark.read.schema(f"{SHARD} int").parquet(done)
        todo = df.join(F.broadcast(there), SHARD, "left_anti")  # a number for each shard
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    out = mapped(todo)
    # shards without a finished mark are replaced, others stay
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(rows)
    todo.select(SHARD).distinct().coalesce(1).write.mode("append").parquet(done)
    return spark.read.schema(out.schema).parquet(rows).drop(SHARD)


def _mapped(
    df: DataFrame, function: Callable, new: T.StructType, wanted: list[str], removed: list[str], with_indices: bool, with_rank: bool,
    batched: bool, batch_size: int, drop_last_batch: bool, fn_kwargs: dict | None, carried: str | None = None,
) -> DataFrame:
    """The function over the rows of each partition; a carried column stays in the result, and batches don't cross its values."""
    marked = [c for c, use in ((INDEX, with_indices), (SHARD, with_rank)) if use]
    extra, kwargs = [c for c in (INDEX, SHARD) if c in df.columns], fn_kwargs or {}
    kept = [c for c in df.columns if c not in removed and c not in extra and c not in new.names]
    carry = [carried] if carried else []
    out_schema = T.StructType([*[f for f in df.schema if f.name in kept], *new.fields, *[f for f in df.schema if f.name in carry]])

    def call(given: list, marks: list):
        return function(*given, *marks, **kwargs)

    def one_batch(part: pd.DataFrame) -> pd.DataFrame:
        marks = [part[c] for c in marked]
        if batched:
            given = [part[c].tolist() for c in wanted] if wanted else [{c: part[c].tolist() for c in part.columns if c not in extra}]
            found = pd.DataFrame(call(given, [m.tolist() for m in marks]))
            if len(found) != len(part):  # a batch may change its number of rows if no column is kept beside it
                if kept:
                    raise ValueError("a batch of another size needs remove_columns for all columns")
                return found[new.names].assign(**{c: part[c].iloc[0] for c in carry})
        else:
            rows = part.drop(columns=extra).to_dict("records")
            found = pd.DataFrame([call([r[c] for c in wanted] if wanted else [r], [m.iloc[i] for m in marks]) for i, r in enumerate(rows)], columns=new.names, index=range(len(rows)))
        return pd.concat([part[kept].reset_index(drop=True), found[new.names].reset_index(drop=True), part[carry].reset_index(drop=True)], axis=1)

    def cut_by(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The parts, split where the carried column changes."""
        for part in parts:
            if not carried or part.empty:
                yield part
            else:
                yield from (p for _, p in part.groupby(part[carried].ne(part[carried].shift()).cumsum()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in cut_by(parts):
            if carried and held is not None and len(held) and len(part) and held[carried].iloc[0] != part[carried].iloc[0]:
                if not (batched and drop_last_batch):
                    yield one_batch(held)
                held = None
            held = part.reset_index(drop=True) if held is None else pd.concat([held, part], ignore_index=True)
            while len(held) >= batch_size:
                yield one_batch(held.iloc[:batch_size].reset_index(drop=True))
                held = held.iloc[batch_size:].reset_index(drop=True)
        if held is not None and len(held) and not (batched and drop_last_batch):
            yield one_batch(held)

    if carried:  # each shard's rows together and in order
        df = df.repartition(carried).sortWithinPartitions(*[c for c in (carried, INDEX) if c in df.columns])
    return df.mapInPandas(run, out_schema)


def shuffled(df: DataFrame, key: str, seed: int = 666, name: str | None = None) -> DataFrame:
    """The rows in an order that depends on the key and the seed alone; name adds each row's place in it."""
    hashed = df.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))))
    if name is None:
        return hashed.orderBy("__hash", F.col(f"`{key}`")).drop("__hash")
    return row_index(hashed, ["__hash", key], name).drop("__hash")


def prefix(df: DataFrame, order: Sequence[str], n: int = 150) -> DataFrame:
    """The first n rows in the order (a feature: a small sample for trials)."""
    return df.orderBy(*order).limit(n)


class Chained:
    """Several sources as one sequence: source, place in it, and a place in the whole."""

    def __init__(self, sources: Sequence[DataFrame], order: Sequence[str]):
        self.sources, self.order = list(sources), list(order)

    def rows(self) -> DataFrame:
        """All rows with source_idx and inner_idx."""
        return reduce(DataFrame.unionByName, [row_index(s, self.order, "inner_idx").withColumn("source_idx", F.lit(i)) for i, s in enumerate(self.sources)])

    def __len__(self) -> int:
        return sum(s.count() for s in self.sources)

    def __getitem__(self, i: int):
        for s in self.sources if i >= 0 else []:
            if i < (n := s.count()):
                return row_index(s, self.order, "inner_idx").where(F.col("inner_idx") == i).drop("inner_idx").first()
            i -= n
        raise IndexError("the sequence has fewer rows")
