"""Arrow batches of tokenized documents as flat numbered tokens: counts, pairs and n-grams of many documents by a few array operations.

A document is one row, so nothing is shuffled. A batch is worked on in pieces of about
TOKENS tokens, which bounds the arrays whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = 200_000


def lengths(lists: pa.Array) -> np.ndarray:
    """Numbers of items of each list, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(lists: pa.Array) -> pa.Array:
    return lists.flatten()


def inner_sums(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Sums of inner over runs of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(inner)])
    ends = np.cumsum(outer)
    return upto[ends] - upto[ends - outer]


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` tokens, or one larger row."""
    group = np.maximum(np.cumsum(sizes + 1) - 1, 0) // most  # an empty row counts too
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def numbered(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the tokens in their (bytewise) order, and the distinct tokens in it."""
    d = tokens.dictionary_encode()
    order = pc.sort_indices(d.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[d.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.int64), d.dictionary.take(order)


def map_tokens(df: DataFrame, keys: list[str], tokens: Column, fields: list[T.StructField], found: Callable) -> DataFrame:
    """(keys, fields): found gives, of each token's row and number and of the distinct tokens, the rows' numbers and the fields' arrays."""
    source = df.select(*keys, tokens.alias("__tokens"))
    names = [*keys, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, lengths(batch.column(len(keys)))):
                lists = part.column(len(keys))
                row = np.repeat(np.arange(part.num_rows), lengths(lists))
                at, columns = found(row, *numbered(flat(lists)))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in part.columns[:-1]], *columns], names=names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *fields]))


def map_sentences(df: DataFrame, keep: list[str], tokens: Column, fields: list[T.StructField], found: Callable, *more: Column) -> DataFrame:
    """(keep, fields) of documents with their sentences' tokens, an array of arrays.

    found gives, of each document's number of sentences, each sentence's number of tokens, the
    tokens and the columns `more`, the fields' arrays and the documents' numbers (None: a row for each).
    """
    names = [f.name for f in fields]
    kept = [c for c in keep if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], tokens.alias("__tokens"), *[c.alias(f"__{k}") for k, c in enumerate(more)])
    k = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(k)
            for part in pieces(batch, inner_sums(lengths(lists), lengths(flat(lists)))):
                inner = flat(part.column(k))
                at, columns = found(lengths(part.column(k)), lengths(inner), flat(inner), *part.columns[k + 1 :])
                own = part.columns[:k] if at is None else [c.take(pa.array(at)) for c in part.columns[:k]]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*kept, *names])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:k], *fields]))


def encoded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the tokens in the order in which they appear, and the distinct tokens."""
    d = tokens.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of the given sizes over the values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def counts(row: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Each row's distinct tokens and how often it has them."""
    key, n = np.unique(row * len(words) + code, return_counts=True)
    v = max(len(words), 1)
    return key // v, [words.take(pa.array(key % v)), pa.array(n.astype(np.int64))]


def label_counts(df: DataFrame, label: str, tokens: Column, most: int = 5 * TOKENS) -> DataFrame:
    """(label, token, df, n) of rows that are documents: in how many of a label's rows a token is, and its places. A piece's rows are summed before the shuffle."""
    source = df.select(label, tokens.alias("__tokens"))
    fields = [T.StructField("token", T.StringType()), T.StructField("df", T.LongType()), T.StructField("n", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, lengths(batch.column(1)), most):
                row = np.repeat(np.arange(part.num_rows), lengths(part.column(1)))
                code, words = encoded(flat(part.column(1)))
                labels = part.column(0).dictionary_encode(null_encoding="encode")
                v = max(len(words), 1)
                key, n = np.unique(row * v + code, return_counts=True)
                of_label = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                both, at, many = np.unique(of_label[key // v] * v + key % v, return_inverse=True, return_counts=True)
                sums = np.bincount(at, n, len(both)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(both // v)), words.take(pa.array(both % v)), pa.array(many.astype(np.int64)), pa.array(sums)], names=[label, "token", "df", "n"])

    found = source.mapInArrow(run, T.StructType([source.schema.fields[0], *fields]))
    return found.groupBy(label, "token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def pair_keys(row: np.ndarray, code: np.ndarray, v: int, window: int) -> np.ndarray:
    """(row * v + a) * v + b of each row's pairs of different tokens within the window, a < b, each once, in order."""
    found = []
    for d in range(1, min(window, len(code) - 1) + 1):
        a, b = code[:-d], code[d:]
        near = (row[:-d] == row[d:]) & (a != b)
        a, b = a[near], b[near]
        found.append(np.unique((row[d:][near] * v + np.minimum(a, b)) * v + np.maximum(a, b)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def pairs(window: int) -> Callable:
    """(a, b) of `pair_keys`."""

    def found(row, code, words):
        v = max(len(words), 1)
        key = pair_keys(row, code, v, window)
        return key // v // v, [words.take(pa.array(key // v % v)), words.take(pa.array(key % v))]

    return found


def neighbours(window: int) -> Callable:
    """(token, degree): how many different tokens a row has within the window of a token, for those with any."""

    def found(row, code, words):
        v = max(len(words), 1)
        key = pair_keys(row, code, v, window)
        at, n = np.unique(np.concatenate([key // v, key // v // v * v + key % v]), return_counts=True)
        return at // v, [words.take(pa.array(at % v)), pa.array(n.astype(np.int64))]

    return found


def one_row_each(df: DataFrame, key: str = "doc_id") -> bool:
    """Whether each row has a key of its own: then a row's result is its key's."""
    most = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count_if(F.col(key).isNull()).alias("none")).first()
    return (most.n or 0) <= 1 and most.none == 0
