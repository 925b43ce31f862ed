"""Token ids in compressed blocks with a shared zstandard dictionary.

File format: rows of a table (Parquet without its own compression, written by Spark's
committer, so that any file system and lost executors are handled). A row is a block of
consecutive documents of one shard:

    shard int, block int        place in the ascending order of doc_id
    first, last long            smallest and largest doc_id, for skipping blocks
    dictionary string           sha256 of the dictionary that its frames need
    skip long                   ids of the shard's documents before this block
    doc_ids array<long>         documents of the block in order
    n_tokens array<long>        ids of each, end id included
    offsets array<long>         where each document's frame starts in payload; one more for the end
    payload binary              zstandard frames, one for each document

A frame holds a document's ids as little-endian unsigned 32-bit integers. The dictionary
is stored beside the blocks as a one-row table. A short document is read alone: its
block's offsets give its frame, and the dictionary makes up for its short history.

The dictionary is trained on whole id arrays of a bounded sample: of the `sample_docs`
rows with the smallest hashes of id and text those whose texts fit `sample_bytes`
together. All documents are written.

Shards are ranges of doc_id, as many as the session's shuffle partitions, or more where
the table has more than `shard_bytes` for each. Rows that share an id are ordered by their
texts' hashes, and dealt over several shards by these where they are many.

Null texts count as empty and hold the end id only. Documents without an id come first.
Repeated rows are each stored. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import no_gc, shared_dir, slices

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 256
CACHE_WORDS = 1_000_000
ENCODE_BYTES = 8 << 20
#: Documents that a shard has at least on the average, where the table is large enough for several.
SHARD_DOCS = 1024
BLOCKS = "shard int, block int, first long, last long, skip long, dictionary string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


#: ASCII marks; and letters that are one character in lower case too (İ is not).
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SIMPLE = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
LETTERS = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(SIMPLE, c))


class Known:
    """Words and their ids: places by word, and flat arrays of ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        """The empty word, of no ids, stays."""
        self.places = {"": 0}
        self.starts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])


def runs(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, one after the other."""
    ends = np.cumsum(counts)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


class Encoder:
    """Ids of texts by a tokenizers file, with the ids of words kept.

    Tokenizers whose pre-tokenizer drops white space give a text the ids of its words
    (split at ASCII white space) one after the other; the others get the whole text. A
    batch's words are split, made distinct and looked up as Arrow arrays; the library gets
    those that are not known yet. Where the pre-tokenizer moreover cuts words of SIMPLE
    letters and MARKS after them in two and the model marks the end of each part
    (`WORD_PARTS`), the parts are what is known, and the library's model gets many new ones
    in one call; the end marks tell which ids are whose. Other words go through the whole
    tokenizer.
    """

    #: The pre-tokenizer's pattern whose cuts of SIMPLE words are known, and the mark.
    WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END_MARK = "</w>"

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._drops_space(spec)
        self.model = None
        self.known = Known()
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if self.by_word and first["pattern"]["Regex"] == self.WORD_PARTS and spec["model"].get("end_of_word_suffix") == self.END_MARK and not spec["model"].get("ignore_merges"):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(self.END_MARK)]] = True

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        first = parts[0]
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        plain = all(s.get("type") in ("NFC", "Lowercase", "Replace", None) for s in steps)
        keeps = any(t.get("lstrip") or t.get("rstrip") or set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in spec.get("added_tokens") or [])
        return plain and not keeps and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in (first.get("pattern") or {}).get("Regex", "")

    def _learn_parts(self, parts: list[str]) -> None:
        """The ids of new parts of SIMPLE words."""
        texts = [" ".join(parts[a : a + 1000]) for a in range(0, len(parts), 1000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts):
            raise ValueError("the model's end marks don't tell its words apart")
        self.known.add(parts, ids, np.diff(stops, prepend=0))

    def _learn_words(self, words: list[str]) -> None:
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.known.add(words, np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def _places(self, words: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The words' places among the known ones; new ones are learned first."""
        coded = words.dictionary_encode()
        distinct, places = coded.dictionary.to_pylist(), self.known.places
        if new := list(filterfalse(places.__contains__, distinct)):
            learn(new)
        return np.fromiter(map(places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and the number of each."""
        if len(self.known.places) > CACHE_WORDS:
            self.known.clear()
        if self.model is None:
            at = self._places(words, self._learn_words)
            return runs(self.known.ids, self.known.starts[at], self.known.counts[at]), self.known.counts[at]
        head = pc.utf8_rtrim(words, MARKS)
        simple = pc.match_substring_regex(head, f"^(?:{SIMPLE})+$")
        own = simple.to_numpy(zero_copy_only=False)
        at = np.zeros((len(words), 2), np.int64)
        at[own, 0] = self._places(pc.utf8_lower(head.filter(simple)), self._learn_parts)
        at[own, 1] = self._places(pc.utf8_ltrim(words.filter(simple), LETTERS), self._learn_parts)
        at[~own, 0] = self._places(words.filter(pc.invert(simple)), self._learn_words)
        counts = self.known.counts[at]
        return runs(self.known.ids, self.known.starts[at].ravel(), counts.ravel()), counts.sum(axis=1)

    def __call__(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other as little-endian unsigned 32-bit integers, end ids included; and where each text's begin, with the end."""
        if self.by_word:
            split = pc.ascii_split_whitespace(texts)
            coded = split.flatten().dictionary_encode()
            found, counts = self._distinct(coded.dictionary)
            own = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(found)).take(coded.indices)
            ids = own.flatten().to_numpy()
            offsets = np.asarray(own.offsets)[np.asarray(split.offsets) - split.offsets[0].as_py()]
        else:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids, offsets = np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        if end_id is not None:
            ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, whatever its number of tasks."""
    return Encoder(path)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or an empty one where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _samples(rows: DataFrame, encode: Encoder, end_id: int | None, sample_docs: int, sample_bytes: int) -> list[bytes]:
    """Whole id arrays of a sample: of the sample_docs rows with the smallest hashes those whose texts fit the bytes together."""
    sizes = rows.select("hash", F.octet_length("text").alias("n")).orderBy("hash", "n").limit(sample_docs).collect()
    chosen, total = set(), 0
    for r in sizes:
        if r.hash not in chosen and total + r.n <= sample_bytes:
            chosen.add(r.hash)
            total += r.n
    wanted = rows.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "hash long")
    texts = rows.join(F.broadcast(wanted), "hash").groupBy("hash").agg(F.min("text").alias("text")).orderBy("hash").collect()
    ids, offsets = encode(pa.array([r.text for r in texts], pa.string()), end_id)
    return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """The shard of each row, and their number: ranges of (doc_id, hash) of about equal numbers of rows, from the ids alone.

    An id that holds more than a shard's rows (no id is one of them) has several shards,
    dealt by ranges of the hash.
    """
    spark = rows.sparkSession
    known, total = rows.agg(F.count("doc_id"), F.count(F.lit(1))).first()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as Spark's planner knows it
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes) if size < 1 << 60 else 0)
    n = max(1, min(n, total // SHARD_DOCS + 1))
    part = lambda k: F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * k), F.lit(k - 1)).cast("int")
    without = max(1, round(n * (total - known) / total)) if total > known else 0
    marks = rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 and known else []
    cuts = sorted({int(c) for c in marks})
    hot = {c: k for c, k in Counter(map(int, marks)).items() if k > 1}
    first, at = {}, without  # the shards of ids up to cut i, and those of a hot cut itself
    for i, c in enumerate(cuts):
        first[i] = at
        at += 1 + hot.get(c, 0)
    shard = F.expr(_bucket(cuts, [*(first[i] for i in range(len(cuts))), at]))
    for c, k in hot.items():
        shard = F.when(F.col("doc_id") == c, first[cuts.index(c)] + 1 + part(k)).otherwise(shard)
    return F.when(F.col("doc_id").isNull(), part(max(1, without))).otherwise(shard).cast("int"), at + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, text: str = "text", sample_docs: int = 1000, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, shard_bytes: int = 128 << 20) -> None:
    """Writes the documents' ids under path: blocks, and the dictionary."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("doc_id", "text"))
    dictionary = train_dictionary([s for s in _samples(rows, encoder(tokenizer), end_id, sample_docs, sample_bytes) if len(s) > 8], dictionary_bytes)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, data binary").write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)
    # the texts are moved once, without a sampling pass over them
    shard, n = _shards(rows, shard_bytes)
    ranged = rows.withColumn("shard", shard).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "hash").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        pressed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(sent.value) if sent.value else None)
        ids, counts, offsets, frames, block, at, skip = [], [], [0], [], 0, None, 0

        def out() -> pa.RecordBatch:
            nonlocal skip
            known = [i for i in ids if i is not None]
            row = {"shard": at, "block": block, "first": known[0] if known else None, "last": known[-1] if known else None, "skip": skip, "dictionary": name, "doc_ids": list(ids), "n_tokens": list(counts), "offsets": list(offsets), "payload": b"".join(frames)}
            skip += sum(counts)
            for x in (ids, counts, frames):
                x.clear()
            offsets[:] = [0]
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                with no_gc():
                    found, places = encode(part.column("text"), end_id)
                raw, places = memoryview(found).cast("B"), places.tolist()
                for i, (doc_id, s) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("shard").to_pylist(), strict=True)):
                    if s != at and ids:
                        yield out()
                    if s != at:
                        block = skip = 0
                    at = s
                    frame = pressed.compress(raw[4 * places[i] : 4 * places[i + 1]])
                    ids.append(doc_id)
                    counts.append(places[i + 1] - places[i])
                    frames.append(frame)
                    offsets.append(offsets[-1] + len(frame))
                    if len(ids) >= BLOCK_DOCS or offsets[-1] >= BLOCK_BYTES:
                        yield out()
                        block += 1
        if ids:
            yield out()

    ranged.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("skip", pa.int64()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def _bucket(cuts: list[int], names: list[int]) -> str:
    """The name at the number of cuts that doc_id exceeds, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(names[lo])
        mid = (lo + hi) // 2
        return f"if(doc_id <= {cuts[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return tree(0, len(cuts))


def dictionary_of(spark, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dictionary, bytes(row.data)


def read_tokens(spark, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of all documents; without ids if digest_only.

    start is the number of ids of all documents before it: a shard's is the sum over the
    shards before it (one number for each), then documents are counted in file order.
    """
    name, dictionary = dictionary_of(spark, path)
    sent = spark.sparkContext.broadcast(dictionary)
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = found.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = {r.shard: r.n for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for s in sorted(totals):
        before.append((s, total))
        total += totals[s]
    base = spark.createDataFrame(before, "shard int, base long")
    placed = found.join(F.broadcast(base), "shard").withColumn("block_start", F.col("base") + F.col("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(sent.value) if sent.value else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"block of another dictionary: {row['dictionary']}")
                start, out = row["block_start"], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                view = memoryview(row["payload"])
                for i, doc_id in enumerate(row["doc_ids"]):
                    data = opened.decompress(view[row["offsets"][i] : row["offsets"][i + 1]])
                    n = len(data) // 4
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(data))
                    if not digest_only:
                        out["ids"].append(np.frombuffer(data, "<u4").astype("<i4"))
                    start += n
                columns = [pa.array(out[c], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([] if digest_only else [pa.array(out["ids"], pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    columns = ["dictionary", "doc_ids", "offsets", "payload", "block_start"]
    return placed.select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>"))


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents of that id: skips blocks by their id range, and opens only their frames."""
    _, dictionary = dictionary_of(spark, path)
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.lit(doc_id).between(F.col("first"), F.col("last")))
    at = found.select(F.explode(F.arrays_zip("doc_ids", F.slice("offsets", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("offsets", F.lit(2), F.size("doc_ids")).alias("b"))).alias("d"), "payload").where(F.col("d.doc_ids") == doc_id)
    frames = at.select(F.substring("payload", F.col("d.a").cast("int") + 1, (F.col("d.b") - F.col("d.a")).cast("int")).alias("frame")).collect()
    return [np.frombuffer(opened.decompress(bytes(r.frame)), "<u4").tolist() for r in frames]


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path, digest_only=True)
