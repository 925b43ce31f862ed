"""Near copies of word-shingle Jaccard similarity 0.8 or more: SimHash by BK-trees, confirmed, and an exact way for what its radius misses.

1. A text's set holds the hashes of its five-word shingles (fewer words: one shingle of
   all). Texts of the same set share a key; from here on only distinct sets count.
2. All sets are put in one order of hashes: by value, those that are common in a sample of
   the texts after the others. Any order gives the same result; this one keeps common
   passages out of the prefixes. Two sets of similarity 0.8 or more share one of the
   first n - ceil(0.8 n) + 1 hashes of each (the prefix), so candidates meet in the buckets
   of these. Nothing is missed.
3. Each set has a SimHash of its shingles. The BK-trees of `simhash.links` connect those
   within `radius` bits, sets of one SimHash go with its smallest key, and the exact
   similarity confirms each of these pairs. So do sets that share several buckets with the
   smallest key of each. Most groups are one component then, and their pairs need not be
   taken. Two texts at 0.8 differ in some 9 bits, so step 4 finds the others.
4. In a bucket that still holds several components, the pairs across them are taken. How
   many buckets a pair shares, and where the last of them stands in both, rules out exactly
   those that differ in too many hashes; exact similarity decides on the rest. A bucket of
   over `chunk` sets becomes several, each compared with the bucket's other rows.

Null and empty texts have no shingles and are one group. Rows are answered each, repeated
ones too. Other columns are kept, but for one named group_key. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_texts, written
from lexmill.llm.simhash import TABLE, components, fingerprint_of, links

SHINGLE = 5
#: Rows of two longs that are broadcast at most; more are shuffled.
FEW = 2_000_000
#: One text of SAMPLE tells which hashes are common: those in COMMON of these texts, MOST at most.
SAMPLE, COMMON, MOST = 16, 4, 1_000_000


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of the text's distinct shingles, sorted."""
    words = [w for w in (text or b"").translate(TABLE).split(b" ") if w]
    if not words:
        return np.zeros(0, np.int64)
    k, h = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    runs = [words[j : len(words) - k + 1 + j] for j in range(k)]
    return np.unique(np.array([h(s, 42) for s in map(b" ".join, zip(*runs, strict=True))], dtype="<u8").view("<i8"))


def key_of(own: np.ndarray) -> int:
    """What names a set: a hash of it, zero for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), 42)], dtype="<u8").view("<i8")[0]) if len(own) else 0


def prefix_length(n: int) -> int:
    """n - ceil(0.8 n) + 1 hashes must share one; with a few more, sets that share just one or two can be told apart."""
    return n - (4 * n + 4) // 5 + 1 + n // 16 if n else 0


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the order of all; common is sorted."""
    late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: prefix_length(len(own))]


def _prints(texts: list, common: np.ndarray) -> list[pa.Array]:
    own = [shingles(t) for t in texts]
    prints = [pa.array([f(x) for x in own], pa.int64()) for f in (key_of, len, fingerprint_of)]
    return [*prints, _lists([prefix(x, common) for x in own])]


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes that many texts of a sample hold, sorted."""
    some = docs.select("__text_hash", F.col(f"`{text}`").alias("__t")).where(F.pmod("__text_hash", F.lit(SAMPLE)) == 0)
    make = lambda: lambda texts: [_lists([shingles(t) for t in texts])]
    found = map_texts(some, "__t", [T.StructField("own", T.ArrayType(T.LongType()))], make, []).select(F.explode("own").alias("s"))
    found = found.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST).select("s")
    return np.unique(np.array(found.toArrow().column("s").to_numpy(), np.int64))


def _near(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets (key, own) have a similarity of 0.8 or more."""
    left, right = sets.select(F.col("key").alias("a"), F.col("own").alias("x")), sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _few(df: DataFrame, name: str) -> DataFrame:
    """df as a table, broadcast where it is small, so that the texts need not move to meet it."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def _sets(docs: DataFrame, text: str, prints: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(key, own): the whole sets of the pairs' keys, made again from one text of each."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    need = prints.groupBy("key").agg(F.min("__text_hash").alias("__text_hash")).join(keys, "key", "left_semi").select("key", "__text_hash")
    need = _few(need, f"{name}_keys")
    rows = docs.select("__text_hash", F.col(f"`{text}`").alias("__t")).join(need, "__text_hash").groupBy("key").agg(F.min("__t").alias("__t"))
    make = lambda: lambda texts: [_lists([shingles(t) for t in texts])]
    return written(map_texts(rows, "__t", [T.StructField("own", T.ArrayType(T.LongType()))], make, ["key"]), name)


def _across(rows: DataFrame) -> DataFrame:
    """(a, na, i, b, nb, j), a < b: pairs of a bucket's sets of different components and fit sizes, and the bucket's places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept = None, []
        for batch in batches:
            out = []
            for name, query, key, n, root, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != bucket:
                    bucket, kept = name, []
                for other in kept:
                    if other[3] != root and 5 * min(n, other[1]) >= 4 * max(n, other[1]):
                        out.append((*other[:3], key, n, at) if other[0] < key else (key, n, at, *other[:3]))
                if not query:
                    kept.append((key, n, at, root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "na", "i", "b", "nb", "j"])

    dealt = rows.select("bucket", "query", "key", "n", "root", "at").repartition("bucket").sortWithinPartitions("bucket", "query", "key")
    return dealt.mapInArrow(run, "a long, na long, i long, b long, nb long, j long")


def _fit(met: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes don't rule out a similarity of 0.8: 9 times the hashes in one set alone are na + nb at most."""
    pairs = met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    # up to the last shared hash all is known of both; after it, the rest of the prefix that ends first
    rest = lambda n, at: F.col(n) - F.floor((4 * F.col(n) + 4) / 5) + F.floor(F.col(n) / 16) - F.col(at)
    alone = F.col("i") + F.col("j") + 2 - 2 * F.col("c") + F.least(rest("na", "i"), rest("nb", "j"))
    return pairs.where(9 * alone <= F.col("na") + F.col("nb")).select("a", "b")


def _by_simhash(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys of sets that one SimHash or an edge of the BK-trees brings together."""
    heads = written(prints.groupBy("fp").agg(F.min("key").alias("head"), F.max("key").alias("last")), "heads")
    edges = links(heads.select("fp"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    across = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # most SimHashes have one set: the others' sets alone are looked up, each once
    same = prints.select("fp", "key").distinct().join(heads.where("head < last"), "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    return across.unionAll(same)


def near_copies(docs: DataFrame, text: str = "text", keep: list[str] | None = None, chunk: int = 500, radius: int = 3) -> DataFrame:
    """The kept columns with group_key: rows of one value are linked by similarities of 0.8 or more."""
    out = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none"))  # in a struct no name clashes
    docs, text = docs.select(row.alias("__row"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{text}`")).alias("__text_hash")), "__text"
    fields = [*(T.StructField(c, T.LongType()) for c in ("key", "n", "fp")), T.StructField("prefix", T.ArrayType(T.LongType()))]
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text))

    def make():
        return lambda texts: _prints(texts, common.value)

    prints = written(map_texts(docs, text, fields, make, ["__row", "__text_hash"]), "prints")
    # copies of a set have all their buckets in common: these count once, by the smallest and the largest key
    postings = prints.select("key", "n", F.posexplode("prefix").alias("at", "s"))
    buckets = written(postings.groupBy("s").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("s", "low"), "buckets")
    met = written(postings.join(buckets, "s").distinct(), "met")
    sizes = met.select(F.col("key").alias("a"), F.col("n").alias("na")).distinct()
    star = met.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"), "n").groupBy("a", "b", "n").count().where("count > 2").join(sizes, "a")
    star = star.where("5 * least(n, na) >= 4 * greatest(n, na)").select("a", "b")
    first = written(_by_simhash(prints, radius).unionAll(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    sure = written(_near(_sets(docs, text, prints, first, "first_sets"), first), "sure")
    roots = written(components(sure), "roots")
    more = met.select("s", "key", "n", "at").join(roots, met.key == roots.node, "left").select("s", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    open_ = more.groupBy("s").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s", "size")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("key"), chunks)
    more = more.join(open_, "s").select("s", "key", "n", "at", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), own.cast("int"))).alias("part"))
    more = more.select(F.concat_ws("#", F.col("s").cast("string"), F.col("part").cast("string")).alias("bucket"), (F.col("own") > F.col("part")).alias("query"), "key", "n", "at", "root")
    pairs = written(_fit(_across(more)), "pairs")
    if not pairs.isEmpty():
        late = _near(_sets(docs, text, prints, pairs, "pair_sets"), pairs)
        roots = components(sure.unionAll(late))
    return prints.join(roots, prints.key == roots.node, "left").select(*[F.col("__row")[c].alias(c) for c in out if c != "group_key"], F.coalesce("root", "key").alias("group_key"))
