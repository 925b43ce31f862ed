import zlib

import numpy as np
from lexmill.llm import quality_classifier as S


def auc(pairs):
    good, bad = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in S.op4(spark, d).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    held = [(rows[i].score, y) for i, y in labels if rows[i].held_out]
    assert auc(held) > 0.99
    kept = [rows[i].predicted for i, y in labels if rows[i].held_out and y == 1]
    assert sum(kept) > 0.99 * len(kept)


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, ("### " if i % 3 == 0 else "and ") * 30 + f"word{i}", "x", "y") for i in range(400)], "doc_id long, text string, lang string, source string")
    own = lambda i: int(i % 3 > 0)
    labels = spark.createDataFrame([(i, own(i)) for i in range(400)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, 1 - own(i) if zlib.crc32(str(i).encode()) % 5 == 0 else own(i)) for i in range(400)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in S.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b and all((a[i] >= 0.3) == bool(own(i)) for i in a)


def test_rules_and_column_agree(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(900, len(S.STATS))) * 100
    y = ((x[:, 0] > 20) & (x[:, 3] <= 40) | (x[:, 5] > 120)).astype(float)
    e = S.fit(x, y)
    z = e.intercept + sum(w * r.holds(x) for r, w in zip(e.rules, e.weights, strict=True))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"`__{s}` double" for s in S.STATS))
    got = np.array([r.score for r in df.select("i", e.score().alias("score")).orderBy("i").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == y).mean() > 0.97


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, " \n\n "), (5, "w " * 100000)]
    df = spark.createDataFrame([(*r, "z", 1.5) for r in rows], "doc_id long, text string, score string, __symbols double")
    kept = S.classify(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == ["doc_id", "text", "__symbols", "held_out", "score", "predicted"] and {r["__symbols"] for r in kept.collect()} == {1.5}
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = S.classify(df.drop("__symbols"), none).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0), (3, 7)], "doc_id long, quality int")
    got = S.classify(df.drop("__symbols"), one).collect()
    assert len(got) == 7 and all(r.predicted in (0, 1) for r in got)
    assert S.classify(df.limit(0), one).count() == 0


def plain(text):
    """The statistics by loops over characters, words and lines."""
    t = text.encode()
    words, lines, n = t.split(), t.split(b"\n"), max(len(t), 1)
    many = max(len(words), 1)
    share = lambda chars: 1000 * sum(t.count(bytes([c])) for c in chars) / n
    runs = [words[i : i + 64] for i in range(0, len(words), 64)]
    adjacent = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    return {
        "log_words": np.log2(len(words) + 1), "word_length": sum(len(w) for w in words) / many, "symbols": share(b"#*$%&<>~^_=+@\\"), "pipes": share(b"|"), "upper": share(range(65, 91)), "bangs": share(b"!?"),
        "digits": share(range(48, 58)), "periods": share(b"."), "commas": share(b","), "other_marks": share(b"\"'();:/-[]{}`"), "non_ascii": share(range(128, 256)), "distinct": 1000 * sum(len(set(r)) for r in runs) / many,
        "adjacent": 1000 * adjacent / many, "words_a_line": len(words) / len(lines), "dup_lines": 1000 * repeated / len(lines), "capitals": 1000 * sum(w.istitle() for w in words) / many,
        "stop_words": 1000 * sum(w.lower() in S.STOP_WORDS for w in words) / many, "longest_word": min(max([0, *(len(w) for w in words)]), 1000),
    }


def test_whole_query_against_a_plain_version(spark):
    """Statistics by loops, and the fitted rules applied one by one, for every document."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    e = S.train(docs, labels)
    got = {r.doc_id: r for r in S.op4(spark, d).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = plain(r.text or "")
        assert np.allclose(S.stats_of((r.text or "").encode()), [x[s] for s in S.STATS])
        z = e.intercept
        for rule, w in zip(e.rules, e.weights, strict=True):
            z += w * all((x[S.STATS[k]] > at) == above for k, above, at in rule.terms)
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
