import hashlib
import random
import re
import tracemalloc

import pytest
from lexmill.llm import decontam as S


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    """Number of words, of hit words, and the items found."""
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(window, len(b))
        if not k:
            continue
        for p in {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == p:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids - {"None"})


def tables():
    rnd = random.Random(8)
    text = lambda n, v="abcde": " ".join(rnd.choice(v) + rnd.choice(["", "x", "É"]) for _ in range(n))
    items = [(f"i{k}", text(rnd.choice([1, 2, 3, 9, 10, 11, 40]), "abcdefghijklmnop")) for k in range(30)] + [("n", None), (None, "ax b c"), (None, "e ex"), ("e", "..."), ("i3", "zz yy xx"), ("9", "Same words, twice; same words twice!"), ("10", "same words twice")]
    docs = [(i, text(rnd.randrange(60))) for i in range(60)]
    for i in range(40):
        t = rnd.choice(items)[1] or ""
        docs.append((100 + i, f"{text(5)} {t.upper()[rnd.randrange(5):]}!{t} {text(5)}"))
    return docs + [(200, None), (201, ""), (202, " ,.;"), (None, items[4][1]), (203, "q" * 3_000_000 + " " + items[6][1]), (203, "w " * 600_000 + (items[8][1] or "")), (204, "same words twice same words twice"), (204, "same words twice same words twice")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    docs, items = tables()
    df = spark.createDataFrame([(*d, "z", 7) for d in docs], "doc_id long, text string, hits string, n_words int").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = S.decontaminate(df, bench, block_bytes=block_bytes)
    assert set(got.columns) == {"doc_id", "text", "n_words", "hits", "item_ids"}
    rows = sorted(((repr(r.doc_id), r.n_words, sum(h.end - h.start for h in r.hits), r.item_ids) for r in got.drop("text").collect()), key=repr)
    assert rows == sorted(((repr(d), *brute(t, items)) for d, t in docs), key=repr)


def test_query_and_empty_tables(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(docs[:100], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in S.op1(spark, str(tmp_path)).collect():
        n, hit, ids = brute(dict(docs)[r.doc_id], items)
        assert tuple(r) == (r.doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
    df, none = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert S.decontaminate(df, none).where("size(hits) > 0").count() == 0 and S.decontaminate(df.limit(0), none).count() == 0


def test_tables_are_bounded():
    """Memory of the tables, and of building them, for each byte of the benchmark: 16 MB, a block, stay under 1 GB for a worker process."""
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(40_000)]
    items = [(str(i), " ".join(rnd.choice(vocabulary) for _ in range(200)).encode()) for i in range(2000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    tables = S.Tables(items, 10)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 20 * size and peak < 50 * size, (kept / size, peak / size)
    text = b"x " + items[7][1] + b" y " + items[9][1][:100]
    n, spans, ids = S.search(text, tables)
    assert ids == {"7", "9"} and spans[0] == [1, 201]
