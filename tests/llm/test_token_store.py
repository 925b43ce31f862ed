import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from lexmill.llm import token_store as S
from lexmill.llm.common import shared_dir
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = {
    5: "Hello, World! it's 2024\n\ttwo  spaces\r\nx\x0by\x0cz", 1: "", 9: None, 7: "naïve café — ÉÀ İ 你好  nbsp em é Å", 2: "a" * 5000 + " b",
    12: " ".join(f"w{i}" for i in range(20000)), -3: "#$%&!!! '' 's 't don't I'LL <|endoftext|> x<|startoftext|>y ΑΣ Σ", 4: " \n ", 30: "same", 31: "same",
}


def expected():
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for d in sorted(TEXTS):
        ids = t.encode(TEXTS[d] or "", add_special_tokens=False).ids + [2]
        out.append((d, start, ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_against_the_library(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3).selectExpr("*", "1 as start", "'x' as ids")
    path = shared_dir(spark)
    S.write_tokens(df, path, PATH)
    got = [(r.doc_id, r.start, r.ids, r.ids_crc32) for r in S.read_tokens(spark, path).orderBy("doc_id").collect()]
    assert got == expected()
    assert S.read_document(spark, path, 7) == [expected()[5][2]] and S.read_document(spark, path, 99) == []


def test_nulls_repeats_and_empty(spark):
    path = shared_dir(spark)
    S.write_tokens(spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string"), path, PATH)
    rows = [(r.doc_id, r.start, r.n_tokens) for r in S.read_tokens(spark, path, True).orderBy("start").collect()]
    assert rows == [(None, 0, 2), (1, 2, 2), (1, 4, 2)] and len(S.read_document(spark, path, 1)) == 2
    path = shared_dir(spark)
    S.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert S.read_tokens(spark, path).count() == 0


def test_words_alone_give_the_ids_of_the_text(spark):
    e, t = S.Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.by_word and e.model is not None
    rnd = random.Random(2)
    alphabet = "abcXYZéÀßñŞİıŉǅ" + "'.,!#$|-_/<>" + "0٣" + " \n\t\r\xa0\u0301\u2028ΑΣς你🙂" + "st"
    texts = [x for x in TEXTS.values() if x] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(5000)]
    texts += ["".join(map(chr, range(a, a + 64))) for a in range(0x21, 0x300, 64)] + [chr(c) + "a" + chr(c) + "." for c in range(0x21, 0x300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, at = e(pa.array(texts), None)
    assert at[-1] == len(ids) == sum(len(t.encode(x, add_special_tokens=False).ids) for x in texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)[:99]
    part = pa.array(texts[:50]).slice(7, 20)
    assert e(part, 2)[0].tolist() == [i for x in texts[7:27] for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    whole = S.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = whole(pa.array(["a b", ""]), 7)
    assert not whole.by_word and at.tolist() == [0, len(ids) - 1, len(ids)] and ids.tolist() == [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a b").ids, 7, 7]
    assert [len(x) for x in e(pa.array([], pa.string()), 2)] == [0, 1]


def test_ties_and_hot_ids(spark):
    """Rows that share an id, or have none, are dealt over shards and come in the order of their hashes in every run."""
    rows = [(None, f"null {i}") for i in range(3000)] + [(7, f"seven {i}") for i in range(3000)] + [(i, f"t {i}") for i in range(3000)]
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    for parts in (3, 7):
        df, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), shared_dir(spark)
        S.write_tokens(df, path, PATH)
        blocks = spark.read.parquet(f"{path}/blocks")
        assert blocks.where("first is null").select("shard").distinct().count() > 1 and blocks.where("first <= 7 and last >= 7").select("shard").distinct().count() > 1
        found.append([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in S.read_tokens(spark, path, True).orderBy("start").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 9000
    assert [r[0] for r in found[0]] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    for _, at, n, _ in found[0]:
        assert at == start
        start += n


def test_sample_takes_whole_texts(spark):
    rows = spark.createDataFrame([(i, "word " * 10 ** (i % 4), i) for i in range(40)], "doc_id long, text string, hash long")
    got = S._samples(rows, S.encoder(PATH), 2, 40, 12_000)
    want, total = [], 0
    for i in range(40):
        if total + 5 * 10 ** (i % 4) <= 12_000:
            total += 5 * 10 ** (i % 4)
            want.append(10 ** (i % 4) + 1)
    assert [len(x) // 4 for x in got] == want and 1001 in want and len(want) < 40
