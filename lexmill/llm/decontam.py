"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of `window` consecutive words (an item of fewer
words is one window). The alphabet is words: a shift table over blocks of two words says
how far the search may jump, buckets by a window's last and first block select the
windows to test, and a direct comparison confirms each occurrence. Windows of one length
form one table set, so that a short item does not shorten the jumps for the others.

Texts are scanned where they are read: no shuffle. The benchmark is sent to executors
in blocks of about `block_bytes`; if it has several blocks, the documents pass once for
each and are written to the shared folder between the passes, so that one block's tables
are in memory at a time. These are arrays of numbers, some 15 bytes for each byte of the
block, and each worker process builds them once.

Null and empty texts have no words. The windows of a benchmark row without an id count for
the hits, but the row can't be named in a result; repeated ids count once. Repeated documents are each answered. Other
columns of the documents are kept unless they have a result's name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import no_gc, slices, written

#: ASCII letters to lower case, other ASCII but digits to a space; other bytes stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT_BYTES = 1 << 20
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class WuManber:
    """Windows of one length k over word numbers; all tables are arrays of numbers.

    flat holds the items' words one after the other, starts the windows' places in it, rel
    their places in their items, items the number of each window's item. A block of two
    words (one if k is 1) is one number; `keys` are the blocks of all windows, sorted, and
    `codes` says of each how far the search may jump (negative), or the bucket of the
    windows that end with it. In a bucket windows are sorted by a hash of their words.
    """

    PRIME = 1_000_003

    def __init__(self, k: int, flat: np.ndarray, starts: np.ndarray, rel: np.ndarray, items: np.ndarray, n_words: int):
        self.k, self.block, self.flat, self.n_words = k, min(2, k), flat, n_words
        self.far = k - self.block + 1
        self.powers = [pow(self.PRIME, k - 1 - j, 1 << 64) for j in range(k)]
        ends = self._keys(flat, starts + k - self.block)
        # a window's blocks but its last are the last ones of the windows before it, unless it is its item's first
        first = starts[rel == 0]
        others = [(self._keys(flat, first + j), k - self.block - j) for j in range(k - self.block)]
        keys = np.concatenate([ends, *[x for x, _ in others]])
        jumps = np.concatenate([np.zeros(len(ends), np.int32), *[np.full(len(x), j, np.int32) for x, j in others]])
        order = np.lexsort((jumps, keys))
        keys, jumps = keys[order], jumps[order]
        least = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, jumps = keys[least], jumps[least]
        del keys, order, least
        last = jumps == 0
        self.codes = np.where(last, np.cumsum(last) - 1, -jumps).astype(np.int32)
        bucket = self.codes[np.searchsorted(self.keys, ends)]
        del ends
        hashes = np.zeros(len(starts), np.uint64)
        for j, p in enumerate(self.powers):
            hashes += (flat[starts + j] + 1).astype(np.uint64) * np.uint64(p)
        order = np.lexsort((items, hashes, bucket))
        self.bounds = np.searchsorted(bucket[order], np.arange(int(last.sum()) + 1))
        self.hashes, self.places, self.items = hashes[order], starts[order].astype(np.int32), items[order]

    def _keys(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return words[at].astype(np.int64) * self.n_words + words[at + 1] if self.block == 2 else words[at].astype(np.int64)

    def scan(self, words: np.ndarray, first: int, spans: list[list[int]], found: set[int]) -> None:
        """Adds the occurrences in words (-1 for those that no window has), of which the first one has the number `first`."""
        k, block, n = self.k, self.block, len(words)
        if n < k:
            return
        known = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0) if block == 2 else words >= 0)
        own = self._keys(words, known)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        codes = np.full(n - block + 1, -self.far, np.int32)
        codes[known] = np.where(self.keys[at] == own, self.codes[at], -self.far)
        if not (codes >= 0).any():
            return
        step, i = codes.tolist(), k - 1
        while i < n:
            code = step[i - block + 1]
            if code < 0:
                i -= code
                continue
            a = i - k + 1
            window = words[a : i + 1]
            h = sum((w + 1) * p for w, p in zip(window.tolist(), self.powers, strict=True)) & ((1 << 64) - 1)
            lo, hi = self.bounds[code], self.bounds[code + 1]
            j = lo + int(np.searchsorted(self.hashes[lo:hi], np.uint64(h)))
            hit = False
            while j < hi and self.hashes[j] == h:
                if (self.flat[self.places[j] : self.places[j] + k] == window).all():
                    hit = True
                    found.add(int(self.items[j]))
                j += 1
            if hit:
                spans.append([first + a, first + i + 1])
            i += 1


class Tables:
    """A block of the benchmark: numbers of its words, its items' ids, and an engine for each length of windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        texts = [np.array([number(w, len(self.numbers)) for w in words_of(t)], np.int32) for _, t in items]
        flat = np.concatenate([np.zeros(0, np.int32), *texts])
        offset, by = 0, defaultdict(list)
        for i, t in enumerate(texts):
            if k := min(window, len(t)):
                n = len(t) - k + 1
                by[k].append((np.arange(offset, offset + n), np.arange(n), np.full(n, i, np.int32)))
            offset += len(t)
        del texts
        self.engines = []
        for k in sorted(by):
            starts, rel, own = (np.concatenate(x) for x in zip(*by.pop(k), strict=True))
            self.engines.append(WuManber(k, flat, starts, rel, own, max(1, len(self.numbers))))

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))


def joined(spans: list[list[int]]) -> list[list[int]]:
    """The union of the spans as disjoint spans in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search(text: bytes | None, tables: Tables) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, hit spans of word numbers, ids of the items found. Long texts go through in segments."""
    data, overlap = text or b"", max([e.k for e in tables.engines], default=1) - 1
    spans: list[list[int]] = []
    found: set[int] = set()
    carry = np.zeros(0, np.int32)
    n = at = 0
    while at < len(data):
        end = at + SEGMENT_BYTES
        while end < len(data) and TABLE[data[end]] != 32:  # a segment ends between words
            end += 1
        new = tables.number(data[at:end].translate(TABLE).split())
        words = np.concatenate([carry, new]) if len(carry) else new
        for e in tables.engines:
            e.scan(words, n - len(carry), spans, found)
        n += len(new)
        carry = words[-overlap:] if overlap and end < len(data) else words[:0]
        at = end
    return n, joined(spans), {tables.ids[i] for i in found if tables.ids[i] is not None}


#: The tables that this worker process has built last, by the benchmark block they are of.
_BUILT: dict[str, Tables] = {}


def _tables(name: str, items: list[tuple[str | None, bytes]], window: int) -> Tables:
    """Built once for each worker process, whatever its number of tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Tables(items, window)
    return _BUILT[name]


def _pass(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, text: str, keep: list[str] | None, before: bool = False) -> DataFrame:
    """The documents with FIELDS by one block of the benchmark; before: joined with what the columns __hits and __ids hold from earlier blocks."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    names = [f.name for f in FIELDS]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    earlier = ["__hits", "__ids"] if before else []
    source = docs.select(*[F.col(f"`{c}`") for c in [*kept, *earlier]], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(kept)], *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(name, sent.value, window)
        for batch in batches:
            for part in slices(batch, "__text"):
                with no_gc():
                    rows = [search(t, tables) for t in part.column("__text").to_pylist()]
                if before:
                    old = zip(part.column("__hits").to_pylist(), part.column("__ids").to_pylist(), strict=True)
                    rows = [(n, joined([*spans, *([s["start"], s["end"]] for s in hits)]), ids.union(more)) for (n, spans, ids), (hits, more) in zip(rows, old, strict=True)]
                found = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _HITS),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *found], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents with n_words, hits (disjoint spans of word numbers) and item_ids (sorted strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    own = items.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    load = lambda b: [(r.id, bytes(r.t)) for r in own.where(F.col("block") == b).select("id", "t").distinct().collect()]
    if blocks == 1:
        return _pass(docs, load(0), window, text, keep)
    out = [c for c in (docs.columns if keep is None else keep) if c not in [f.name for f in FIELDS]]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").alias("__t"))
    for b in range(blocks):
        df = _pass(df, load(b), window, "__t", ["__row", "__t"], before=b > 0)
        if b < blocks - 1:
            df = written(df.select("__row", "__t", F.col("hits").alias("__hits"), F.col("item_ids").alias("__ids")), "decontam")
    return df.select(*[F.col("__row")[c].alias(c) for c in out], *[f.name for f in FIELDS])


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op1(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = decontaminate(read("documents"), read("benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


SQL1 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct id, k, array_to_string(w[i:i + k - 1], ' ') win from (select id, w, k, unnest(range(1, len(w) - k + 2)) i from (select *, least(10, len(w)) k from b where len(w) > 0))),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from bw) where len(w) >= k)),
hit as (select doc_id, k, i, id from dw join bw using (k, win)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hit) group by 1),
ids as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) s from (select distinct doc_id, id from hit where id is not null) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join ids using (doc_id)
"""
