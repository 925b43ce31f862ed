import random
import re

import xxhash
from lexmill.llm import simhash as S


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                top[max(root(i), root(j))] = min(root(i), root(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            comp[root(i)] = min(comp.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", comp.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def texts(n):
    rnd = random.Random(7)
    vocab = ["Éa", "the", "of", "x y", "B2", *[f"w{i}" for i in range(300)]]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            w = rnd.choice(out).split(" ")
            if w and rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = "new"
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 40, 300]))))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.near_duplicates(df, **options)
    return sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))] + [(500, None), (501, ""), (502, " \t\n"), (None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c")]
    assert run(spark, rows) == brute(rows)


def test_hot_shards_are_dealt_again_without_loss(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    assert run(spark, rows, shard_rows=3) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, component_id int, extra int")
    got = S.near_duplicates(df)
    assert got.count() == 0 and got.columns == ["doc_id", "text", "extra", "fp", "group_fp", "component_id"]


def test_tree_finds_all_within_the_radius():
    rnd = random.Random(1)
    values = [rnd.getrandbits(64)]
    for _ in range(300):
        values.append(rnd.choice(values) ^ (1 << rnd.randrange(64)))
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 3)) == sorted({x for x in values if (x ^ v).bit_count() <= 3})
