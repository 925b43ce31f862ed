import json

from lexmill.operators import terms
from lexmill.plans import corpus as plan
from lexmill.sources import corpus
from lexmill.streaming.analyze import analyze_stream, read_stream
from pyspark.sql import functions as F


def raw(tmp_path, n=30):
    path = tmp_path / "raw"
    path.mkdir()
    for part in range(2):
        rows = [{"id": i, "title": f"Title {i}", "text": f"river mountain valley {'forest' if i % 2 else 'desert'} stone <b>water</b> words", "label": "ab"[i % 2]} for i in range(part, n, 2)]
        (path / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_round_trips(spark, tmp_path):
    docs = corpus.read_jsonl(spark, raw(tmp_path))
    assert docs.count() == 30
    for _ in range(2):  # the second replaces the first
        corpus.write_dataset(docs, f"{tmp_path}/d")
    assert corpus.read_many(spark, [f"{tmp_path}/d"] * 2, corpus.RAW).count() == 60
    vocab = spark.createDataFrame([(0, 'a"b', 3), (1, "ü", 1)], "token_id long, token string, df long")
    corpus.write_vocabulary(vocab, f"{tmp_path}/v")
    assert sorted(corpus.read_vocabulary(spark, f"{tmp_path}/v").collect()) == sorted(vocab.collect())
    bow = spark.createDataFrame([(0, 1, 0.3), (0, 2, 0.1), (2, 0, 2.0)], "doc_id long, token_id long, cnt double")
    corpus.write_matrix_market(bow, f"{tmp_path}/mm")
    assert sorted(map(tuple, corpus.read_matrix_market(spark, f"{tmp_path}/mm").collect())) == sorted(map(tuple, bow.collect()))
    plain = tmp_path / "x.mm"
    plain.write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 2\n1 2 0.5\n3 1 4\n")
    assert sorted(map(tuple, corpus.read_matrix_market(spark, str(plain)).collect())) == [(0, 1, 0.5), (2, 0, 4.0)]
    corpus.write_svmlight(bow, f"{tmp_path}/svm")
    assert sorted(r.features.toArray().tolist() for r in corpus.read_svmlight(spark, f"{tmp_path}/svm", 3).collect()) == [[0, 0.3, 0.1], [2.0, 0, 0]]
    one = tmp_path / "w.json"
    one.write_text('{"a": 0.5, "ü": 2}')
    w = corpus.read_weights(spark, str(one))
    corpus.write_weights(w, f"{tmp_path}/w")
    assert sorted(map(tuple, corpus.read_weight_lines(spark, f"{tmp_path}/w").collect())) == [("a", 0.5), ("ü", 2.0)]


def test_plan_and_stream(spark, tmp_path):
    path = raw(tmp_path)
    docs = corpus.read_jsonl(spark, path).withColumnRenamed("id", "doc_id")
    model = plan.build(spark, docs, f"{tmp_path}/out", 2, no_below=2, no_above=0.9, chunk_share=0.5, columns=("title", "text"))
    assert model.model is not None
    mined = corpus.read_mining(spark, f"{tmp_path}/out/mining")
    assert mined["doc_topic"].groupBy("doc_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    weights = [r.weight for r in corpus.read_weight_lines(spark, f"{tmp_path}/out/word_weights").collect()]
    assert min(weights) == 0 and max(weights) in (0.0, 1.0)
    q = analyze_stream(read_stream(spark, path), f"{tmp_path}/s", f"{tmp_path}/c")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/s").select("id", "tokens").orderBy("id").collect()
    want = plan.tokenized(corpus.read_jsonl(spark, path)).select("id", "tokens").orderBy("id").collect()
    assert got == want and "water" in got[0].tokens and len(got) == 30


def test_links_and_log(spark, tmp_path):
    pages = spark.createDataFrame([("u", '<a href="/x">a</a> <a href="/x">b</a>'), ("v", "none")], "url string, html string")
    assert sorted(map(tuple, corpus.page_links(pages).collect())) == [("href:/x", "page:u", 2.0), ("page:u", "href:/x", 2.0)]
    corpus.log_to(f"{tmp_path}/log").info("done")
    assert "done" in (tmp_path / "log").read_text()
    assert terms.vocabulary_union(spark.createDataFrame([("a",)], "token string")).count() == 1
