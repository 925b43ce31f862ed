"""SimHash near-duplicates by BK-trees over shards of the fingerprints.

1. Each text's fingerprint (64 bits) comes from its `shingle`-word shingles, once for
   each occurrence, where the text is read. Copies share one; from here on only distinct
   fingerprints count, each with its smallest document.
2. Two fingerprints at up to `radius` bits agree in at least one of radius + 1 blocks of
   their bits (pigeonhole). A shard is what agrees in one block. A shard of over
   `shard_rows` fingerprints is dealt again by radius + 1 blocks of its remaining bits;
   one that is still larger becomes several trees, each of which the shard's other rows
   search. All of it is exact, and no tree outgrows a task.
3. Each shard is a BK-tree in one task: children are keyed by their Hamming distance to
   the parent, and a search follows only edges within the radius. A shard gives a
   spanning forest of its links, not all its pairs.
4. Components come from the forests' edges by alternating large-star and small-star
   joins with a checkpoint for each round; a document's component is its smallest id.

Null and empty texts have fingerprint zero, which links like any other. Documents without
an id get a fingerprint and a component (null if no linked document has an id). Repeated
rows are each answered. Other columns of the input are kept, but for those named like a
result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_texts, written

#: ASCII letters to lower case, and white space of the word pattern to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
BITS = 64
PIECE = 1 << 16  # shingles counted at once


def _ones(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many of the 64-bit hashes have it."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles by their hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE):
        counts += _ones(hashes[at : at + PIECE])
    return _majority(counts, len(hashes))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The text's SimHash as a signed 64-bit integer."""
    words = [w for w in (text or b"").translate(TABLE).split(b" ") if w]
    if not words:
        return 0
    h, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    counts, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, PIECE):
        runs = [words[at + j : min(at + PIECE, n) + j] for j in range(k)]
        hashes = np.array([h(s, 42) for s in map(b" ".join, zip(*runs, strict=True))], dtype="<u8")
        counts += _ones(hashes)
    return _majority(counts, n)


class BKTree:
    """Distinct 64-bit integers; a node is [value, {distance: node}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            below = node[1].get(d)
            if below is None:
                node[1][d] = [value, {}]
                return
            node = below

    def near(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            at, below = open_nodes.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if below:
                for key, node in below.items():
                    if d - radius <= key <= d + radius:
                        open_nodes.append(node)
        return found


def forest(values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links among values, and between queries and values, connect."""
    mask, tree, top, edges = (1 << BITS) - 1, BKTree(), {}, []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, v in enumerate([*values, *queries]):
        u = v & mask
        top[u] = u
        for other in tree.near(u, radius):
            a, b = root(u), root(other)
            if a != b:
                top[max(a, b)] = min(a, b)
                edges.append((u, other))
        if i < len(values):
            tree.add(u)
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [(signed(a), signed(b)) for a, b in edges]


def _cut(rows: DataFrame, free: list[int], parts: int) -> list[tuple[DataFrame, list[int]]]:
    """The rows once for each block of the free bits, under the shard that the block's bits name; the bits left."""
    out = []
    for block in np.array_split(np.array(free), parts):
        mask = sum(1 << int(b) for b in block)
        mask -= (1 << BITS) if mask >> (BITS - 1) else 0
        key = F.concat("shard", F.lit(f"/{block[0]}:"), F.hex(F.col("fp").bitwiseAND(F.lit(mask))))
        out.append((rows.select("fp", key.alias("shard")), [b for b in free if b not in block]))
    return out


def _deal(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, shard, query): the fingerprints of each shard's tree, and those that only search it."""
    over = lambda d: d.groupBy("shard").count().where(F.col("count") > shard_rows)
    first = _cut(fps.select("fp", F.lit("").alias("shard")), list(range(BITS)), radius + 1)
    rows = reduce(DataFrame.unionAll, [r for r, _ in first])
    plain = lambda d: d.select("fp", "shard", F.lit(False).alias("query"))
    hot = over(rows).select("shard")
    if hot.isEmpty():
        return plain(rows)
    done = plain(rows.join(hot, "shard", "left_anti"))
    second = [x for r, free in first for x, _ in _cut(r.join(hot, "shard", "left_semi"), free, radius + 1)]
    rows = written(reduce(DataFrame.unionAll, second), "hot")
    hot = over(rows)
    if hot.isEmpty():
        return done.unionAll(plain(rows))
    done = done.unionAll(plain(rows.join(hot, "shard", "left_anti")))
    # what still agrees in so many bits: trees of shard_rows at most, each searched by the shard's later rows
    chunks = F.ceil(F.col("count") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks)
    tall = rows.join(hot, "shard").select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), own.cast("int"))).alias("chunk"))
    return done.unionAll(tall.select("fp", F.concat("shard", F.lit("#"), "chunk").alias("shard"), F.col("own") > F.col("chunk")))


def links(fps: DataFrame, radius: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all within the radius."""
    dealt = _deal(fps, radius, shard_rows).select("shard", "query", "fp")
    by_shard = dealt.repartition("shard").sortWithinPartitions("shard", "query", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values, queries = None, [], []

        def out():
            edges = forest(values, queries, radius) if len(values) + len(queries) > 1 else []
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for s, query, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    yield from out()
                    shard, values, queries = s, [], []
                (queries if query else values).append(fp)
        yield from out()

    return by_shard.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node that it reaches."""
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        e = both(cur)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and the lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = small.checkpoint()
        stat = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stat(new) == stat(cur):
            break
        cur = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(new.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, text: str = "text", keep: list[str] | None = None, shard_rows: int = 20_000) -> DataFrame:
    """The documents with fp (the fingerprint as a long), group_fp (one fingerprint of its component) and component_id."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())]

    out = [c for c in (docs.columns if keep is None else keep) if c not in ("fp", "group_fp", "component_id")]
    prints = written(map_texts(docs, text, [T.StructField("fp", T.LongType())], make, [*dict.fromkeys([*out, "doc_id"])]), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, radius, shard_rows))
    ids = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only components of several fingerprints need a further minimum
    many = ids.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    comp = ids.join(many, "root", "left").select("fp", F.col("root").alias("group_fp"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(comp, "fp").select(*[F.col(f"`{c}`") for c in out], "fp", "group_fp", "component_id")


def op8(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
