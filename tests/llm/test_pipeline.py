import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
import test_decontam  # noqa: E402
import test_line_dedup  # noqa: E402
from lexmill.llm import pieces, simhash  # noqa: E402
from lexmill.llm import quality_classifier as quality  # noqa: E402


def fixture():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", word(), word(), word()]) for _ in range(n))
    items = [("b1", prose(30)), ("b2", prose(14)), (None, "x"), ("b3", None)]
    passage = prose(60)
    docs = [(i, "\n".join(prose(rnd.randrange(12, 40)) for _ in range(3))) for i in range(150)]
    docs += [(200 + i, " ".join(word() + "###" for _ in range(60))) for i in range(60)]
    docs += [(300, docs[3][1]), (301, docs[4][1] + " end"), (302, docs[150][1]), (303, f"{prose(20)} {items[0][1][20:160]} {prose(20)}"), (304, prose(20) + "\n" + passage), (305, passage + "\n" + prose(20)), (306, passage)]
    docs += [(400, None), (401, ""), (None, prose(30)), (None, docs[5][1]), (402, "One."), (402, "One."), (403, "word " * 3000 + prose(50))]
    labels = [(d, int(not 200 <= d < 300)) for d, _ in docs[:210]]
    return docs, labels, items


def brute(docs, ensemble, items):
    """The stages as plain loops over a list of (doc_id, text)."""
    def score(t):
        x = np.array([quality.stats_of(None if t is None else t.encode())])
        z = ensemble.intercept + sum(w * r.holds(x)[0] for r, w in zip(ensemble.rules, ensemble.weights, strict=True))
        return 1 / (1 + np.exp(-z))

    docs = [(d, t) for d, t in docs if score(t) >= 0.3]
    docs = [(d, None if t is None else new) for (d, t), new in zip(docs, test_line_dedup.kept_texts(docs), strict=True)]
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    kept = []
    for g in set(group):
        own = [docs[i] for i in range(len(docs)) if group[i] == g]
        kept.append(min((d for d in own if d[0] is not None), key=lambda d: d[0], default=None) or own[0])
    return [(d, t) for d, t in kept if not test_decontam.brute(t, items)[1]]


def test_run_against_loops(spark, tmp_path):
    docs, labels, items = fixture()
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    ensemble = quality.train(read("documents"), read("labels"))
    want = brute(docs, ensemble, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((d, m.library.encode(t or "")) for d, t in want), key=key)
    ids = {r.doc_id for r in got}
    assert all(r.round_trip for r in got) and not ids & {*range(200, 260), 303} and {0, 1, 2, 3, 4, 304} <= ids
    assert sum(not r.ids for r in got) == 1  # what lost all its lines, or had none, is one group


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in docs], "doc_id long, text string, hits string, score int, predicted double")
    for some in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            if name in ("quality", "near_copies", "benchmark_free", "lines"):
                assert out.columns == df.columns, name
        assert out.count() <= some.count()


def test_near_copies_with_maps_and_clashing_names(spark, tmp_path):
    rows = [(1, "the same words of a text " * 5, {"a": 1}, "z"), (2, "the same words of a text " * 5, None, "z"), (3, "another one", {"b": 2}, "y"), (3, "another one", {"b": 3}, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, __h string")
    out = corpus_pipeline.near_copies(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted((r.doc_id, r["__h"]) for r in out.collect()) == [(1, "z"), (3, "y")]


def test_stage_names_and_numbers():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark_free", "tokens"] and corpus_pipeline.ORACLE_SQL is None
