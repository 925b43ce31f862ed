import random

import corpus_pipeline
from lexmill.llm import near_copies as S
from pyspark.sql import functions as F


def jaccard(a, b):
    a, b = (set(S.shingles(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(30)], []
    for i in range(40):
        base = [word() for _ in range(rnd.randrange(40, 200))] + (passage if i % 2 else [])
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(rnd.randrange(1, 6)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def brute(texts):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_groups_against_all_pairs(spark, monkeypatch):
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {}
    for i, g in enumerate(brute(texts)):
        want.setdefault(g, set()).add(i)
    assert 45 < len(want) < len(texts) - 20
    for chunk, sample in ((500, S.SAMPLE), (7, 1)):
        monkeypatch.setattr(S, "SAMPLE", sample)
        got = {}
        for r in S.near_copies(df, keep=["doc_id"], chunk=chunk).collect():
            got.setdefault(r.group_key, set()).add(r.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_stage_drops_a_copy_beyond_three_bits(spark):
    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    edited[60] = edited[140] = "x"
    far = list(words)
    for i in range(5, 200, 10):
        far[i] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far)), (4, None), (5, "")]
    assert jaccard(rows[0][1], rows[1][1]) > 0.8 > jaccard(rows[0][1], rows[2][1])
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_stage_keeps_a_row_of_each_group_that_shares_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (2, texts[1])]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, texts[0]), (1, texts[1])]


def test_simhash_brings_close_copies_together(spark):
    words = [f"w{i}" for i in range(400)]
    edited, other = list(words), [f"v{i}" for i in range(400)]
    edited[200] = "x"
    texts = [" ".join(words), " ".join(edited), " ".join(other), "", None]
    own = [S.shingles(None if t is None else t.encode()) for t in texts]
    keys, fps = [S.key_of(x) for x in own], [S.fingerprint_of(x) for x in own]
    bits = ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count()
    assert fps[3] == fps[4] == 0 and 0 < bits < 9
    prints = spark.createDataFrame([*zip(fps, keys, strict=True)] * 2 + [(fps[2], 5)], "fp long, key long")
    pairs = lambda radius: {frozenset((r.a, r.b)) for r in S._by_simhash(prints, radius).collect()}
    same = frozenset((keys[2], 5))
    assert pairs(bits) == {same, frozenset(keys[:2])} and pairs(bits - 1) == {same}


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b", 7, 8, 9), (None, None, 7, 8, 9)], "doc_id long, text string, fp int, key int, n int").withColumn("group_key", F.lit("old"))
    out = S.near_copies(df)
    assert out.columns == ["doc_id", "text", "fp", "key", "n", "group_key"]
    rows = out.collect()
    assert len(rows) == 3 and {(r.fp, r.key, r.n) for r in rows} == {(7, 8, 9)} and len({r.group_key for r in rows}) == 2
    assert S.near_copies(df.limit(0)).count() == 0
