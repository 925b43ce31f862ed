import math
import random

import numpy as np
import pytest
from lexmill.functions import lists
from lexmill.operators import dataset, graph, information, matrix, metrics, phrases, retrieval, summary, terms, textrank, topics
from pyspark.sql import functions as F

# fixed values: inputs whose results are known
WORDS = "程序员 英文 Programmer 从事 程序 开发 维护 专业 人员 程序员 分为 程序设计 人员 程序 编码 人员 界限 并不 非常 清楚 特别是在 中国 软件 从业人员 分为 程序员 高级 程序员 系统分析员 项目经理 四大".split()
SENTS = [s.split() for s in ["水利部 水资源 司 司长 陈明忠 9月 国务院新闻办 举行 新闻 发布会 透露", "刚刚 完成 水资源 管理制度 考核", "部分 省 接近 红线 指标", "部分 省 超过 红线 指标", "超过 红线 地方", "陈明忠 表示", "取 用水 项目 进行 区域 限", "严格 进行 水资源 论证 取水 许可 批准"]]


def test_keywords_golden():
    got = graph.keyword_scores(WORDS)
    assert [w for w, _ in got[:5]] == ["程序员", "分为", "程序", "人员", "软件"]
    assert [round(s, 4) for _, s in got[:5]] == [2.0256, 1.5326, 1.5179, 1.3942, 0.9934]
    assert graph.keyword_scores([]) == [] and graph.keyword_scores(["a"])[0][0] == "a"


def dense(sents, k1=1.5, b=0.75):
    n = len(sents)
    mean = sum(map(len, sents)) / n
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            for t in sents[i] if i != j else []:
                f = sents[j].count(t)
                df = sum(t in s for s in sents)
                w[i, j] += (math.log(n - df + 0.5) - math.log(df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(sents[i]) / mean))
    return w


def test_sentence_ranks_golden_and_sums_without_the_square():
    s, order = graph.SentenceGraph(SENTS).rank()
    assert order == [7, 0, 3, 2, 5, 6, 1, 4] and np.allclose(s, [1.3342, 0.7097, 1.0274, 1.3197, 0.6529, 0.8365, 0.7696, 1.3500], atol=1e-4)
    rnd = random.Random(1)
    for _ in range(50):
        sents = [[rnd.choice("abcdef") for _ in range(rnd.randrange(9))] for _ in range(rnd.randrange(1, 9))]
        if not any(sents):
            continue
        g, w, x = graph.SentenceGraph(sents), dense(sents), np.array([rnd.random() for _ in sents])
        assert np.allclose(g.times(x), w @ x) and np.allclose(g.column_sums(), w.sum(axis=0))
    assert graph.SentenceGraph([]).rank()[1] == []


def test_page_rank_sums_to_one_with_dangling_nodes(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "a")]
    names = ["a", "b", "c", "d"]
    i, j = (np.array([names.index(e[k]) for e in edges]) for k in (1, 0))
    s = graph.page_rank(4, i, j, np.ones(4), max_iter=8, min_diff=0)
    assert s.sum() == pytest.approx(1)
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, w double")
    got = {r.node: r.score for r in graph.page_rank_table(df, rounds=8).collect()}
    assert np.allclose([got[n] for n in names], s)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "node string, weight double")
    got = {r.node: r.score for r in graph.page_rank_table(df, rounds=6, weights=weights).collect()}
    assert np.allclose([got[n] for n in names], graph.page_rank(4, i, j, np.ones(4), node_weights=np.array([3.0, 1, 0, 0]), max_iter=6, min_diff=0))
    with pytest.raises(ValueError):
        graph.page_rank(2, i[:1], j[:1], np.array([np.nan]))


def test_summaries_and_keywords_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Solo"), (4, "One two three. Two three four! Three four five? Six."), (5, "12. 34")], "doc_id long, text string")
    got = {r.doc_id: r for r in textrank.summarize(docs, 2, "latin_coarse").collect()}
    assert got[1].summary == "" and got[2].summary == "" and got[3].summary == "Solo" and len(got[4].summary) > 10
    assert {r.doc_id: [k.item for k in r.keywords] for r in textrank.keywords(docs).collect()}[3] == ["solo"]


def greedy_loop(rows, budget):
    """rows: (idx, sentence, weight)"""
    order = sorted(rows, key=lambda r: (-r[2], -r[0]))
    last, taken, used = max(r[0] for r in rows), [], 0
    for r in order:
        if used + len(r[1]) > budget:
            break
        taken.append(r)
        used += len(r[1])
        if r[0] == last:
            break
    return "".join(r[1] for r in sorted(taken)) if taken else order[0][1][:budget]


def test_greedy_is_the_loop(spark):
    rnd = random.Random(3)
    rows = [(d, i, rnd.choice("ab") * rnd.randrange(1, 30), rnd.randrange(6) / 4) for d in range(150) for i in range(rnd.randrange(1, 9))]
    got = {r.doc_id: r.summary for r in summary.greedy(spark.createDataFrame(rows, "doc_id long, idx int, sentence string, weight double"), 40).collect()}
    for d in range(150):
        own = [r[1:] for r in rows if r[0] == d]
        assert got[d] == greedy_loop(own, 40) == summary.taken([r[1:] for r in own], 40)[0]
    assert summary.taken([], 40) == ("", 0)


def test_row_numbers_of_many_wide_rows(spark):
    """A million rows with a column beside the order: the numbers are dense, unique and in order."""
    df = spark.range(1_000_000, numPartitions=4).select(F.expr("pmod(xxhash64(id), 700001)").alias("k"), F.concat_ws(" ", F.lit("text of"), "id").alias("text"))
    got = dataset.row_index(df, ["k"])
    assert got.columns == ["k", "text", "row_index"]
    r = got.agg(F.count("*"), F.countDistinct("row_index"), F.min("row_index"), F.max("row_index"), F.countDistinct("text")).first()
    assert tuple(r) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000)
    runs = got.groupBy("k").agg(F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("n"))
    assert runs.where("b - a + 1 <> n").count() == 0 and runs.join(df.groupBy("k").count(), "k").where("n <> count").count() == 0
    assert [r.k for r in got.orderBy("row_index").limit(2000).select("k").collect()] == [r.k for r in df.orderBy("k").limit(2000).collect()]
    odd = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2}), (None, None)], "k long, m map<string,int>")
    assert [(r.row_index, r.k) for r in dataset.row_index(odd, ["k"]).orderBy("row_index").collect()] == [(0, None), (1, 1), (2, 1)]
    whole = spark.range(1_000_001).select((F.col("id") / 7).alias("weight"), F.lit("x").alias("more"))
    assert terms.upper_median(whole).first().upper_median == 500_000 / 7


def overlap_loop(rows):
    """rows: (tokens, phrase, score) in the candidates' order; every earlier phrase is compared."""
    order = sorted(rows, key=lambda r: -len(r[0]))
    out = []
    for k, (t, p, s) in enumerate(order):
        sim = max((len(set(t) & set(u)) / len(set(t)) for u, _, _ in order[:k]), default=0.0)
        out.append((p, s * (1 - sim), k))
    return [(p, round(s, 9)) for p, s, k in sorted(out, key=lambda x: (-round(x[1], 9), x[2])) if s != 0]


def test_phrase_penalty_against_all_earlier_phrases(spark):
    rnd = random.Random(4)
    for d in range(300):
        longest = 5 if d % 2 else 12
        own = []
        for _ in range(rnd.randrange(1, 20)):
            t = [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(1, longest))]
            own.append((t, " ".join(t), rnd.random()))
        assert [(p, round(x, 9)) for p, x in phrases.without_overlap(own, None)] == overlap_loop(own)
        assert len(phrases.without_overlap(own, 2)) <= 2
    none = spark.createDataFrame([], "token string, weight double")
    with pytest.raises(ValueError):
        phrases.key_phrases(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none, none, top_k=-1)


@pytest.mark.parametrize("rules", [{}, {"strict": False}, {"allow_place": False}, {"strict": False, "allow_person": False, "allow_place": False}, {"specified": ["bb", "e"]}, {"remove_words": ["bb"], "max_window": 3}, {"max_chars": 6, "remove_phrases": ["a c"]}])
def test_phrases_in_a_pass_are_those_of_the_tables(spark, rules):
    rnd = random.Random(6)
    tags = {"a": "n", "bb": "a", "c": "ns", "dd": "nr", "e": "v", "ff": "u", "g": "vn", "de": "n", "hh": "ad"}
    tagger = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]), t), F.lit("n"))
    docs = spark.createDataFrame([(d, ". ".join(" ".join(rnd.choice(list(tags)) for _ in range(rnd.randrange(9))) for _ in range(4))) for d in range(12)] + [(99, None), (98, "")], "doc_id long, text string")
    idf, topic = spark.createDataFrame([("a", 1.0), ("bb", 3.0), ("g", 2.5)], "token string, weight double"), spark.createDataFrame([("a", 0.5), ("c", 0.25)], "token string, weight double")
    rows = phrases.phrase_scores(phrases.candidates(phrases.weighted_tokens(phrases.weighted_sentences(docs, idf, topic, criterion="latin_fine", tagger=tagger, specified=rules.get("specified", ()))), **rules)).orderBy("doc_id", "sent", "pos", "n").collect()
    want = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append(([x.token for x in r.p], r.phrase, r.score))
    got = {}
    for r in phrases.key_phrases(docs, idf, topic, top_k=None, criterion="latin_fine", tagger=tagger, **rules).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.phrase, round(r.score, 9)))
    assert got == {k: v for k, v in ((k, overlap_loop(v)) for k, v in want.items()) if v} and got
    # unknown words weigh the upper median and half the mean
    words = {x.token: (x.idf, x.topic) for r in phrases.weighted_sentences(docs, idf, topic, criterion="latin_fine", tagger=tagger).collect() for x in r.words or []}
    assert words["a"] == (1.0, 0.5) and words["c"] == (2.5, 0.25) and words["hh"] == (2.5, 0.1875) and words["bb"] == (3.0, 0.1875)


def test_phrase_rules_with_a_lexicon(spark):
    tags = {"big": "a", "river": "n", "run": "v", "of": "u", "paris": "ns", "anna": "nr", "fast": "ad"}
    tagger = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]), t), F.lit("n"))
    docs = spark.createDataFrame([(1, "big river of paris run fast. anna big")], "doc_id long, text string")
    none = spark.createDataFrame([], "token string, weight double")
    weighted = phrases.weighted_tokens(phrases.weighted_sentences(docs, none, none, 1.0, 0.5, criterion="latin_fine", tagger=tagger))
    all_of = lambda **o: {r.phrase for r in phrases.candidates(weighted, **o).collect()}
    assert all_of() == {"big river", "river", "paris", "anna"} and all_of(allow_place=False) == {"big river", "river", "anna"}
    assert all_of(specified=["big"]) == {"big river"} and all_of(remove_words=["river"]) == {"paris", "anna"} and all_of(remove_phrases=["river"]) == {"big river", "paris", "anna"}
    assert "anna big" in all_of(strict=False) and not any(" of " in p for p in all_of(strict=False, remove_words=["of"])) and "anna" not in all_of(strict=False, allow_person=False)
    scores = {r.phrase: r.score for r in phrases.phrase_scores(phrases.candidates(weighted)).collect()}
    assert scores["big river"] == pytest.approx((1 / 8 + 1 / 8 + 0 * 0) * 5.6 * lists.TAG_WEIGHTS["a|n"] + 0.25) or scores["big river"] == pytest.approx((2 / 8 + 1 / 8) * 5.6 * lists.TAG_WEIGHTS["a|n"] + 0.25)


def test_statistics(spark):
    w = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "weight double")
    assert terms.upper_median(w).first().upper_median == 3.0
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "token string, weight double")
    assert [r.weight for r in terms.min_max(same).collect()] == [0.0, 0.0]
    lists_ = spark.createDataFrame([(list("ABCDE"), list("BADEF"))], "a array<string>, b array<string>")
    assert lists_.select(metrics.rank_overlap(F.col("a"), F.col("b"), 5).alias("x")).first().x == pytest.approx((0 + 1 + 0.5 + 0.6 + 2 / 3) / 5)
    top = spark.createDataFrame([(0, "房屋"), (0, "平方米"), (0, "建筑"), (1, "平方米")], "topic int, token string")
    assert metrics.diversity(top).first().diversity == 0.5
    weather = spark.createDataFrame([("rain", "coat")] * 1 + [("rain", "shirt")] * 3 + [("sun", "coat")] * 9 + [("sun", "shirt")] * 3, "w string, c string")
    b = {(r.x, r.y): r for r in information.bayes(weather, "w", "c").collect()}
    assert b["rain", "coat"].y_given_x == 0.25 and b["sun", "coat"].px == 0.75 and b["rain", "coat"].x_given_y == pytest.approx(0.1)
    tree = spark.createDataFrame([({"省": {"市": ["县", "区"], "_x": ["y"]}, "_meta": {"a": ["b"]}},)], "tree map<string,map<string,array<string>>>")
    assert {r.place for r in terms.flatten_gazetteer(tree).collect()} == {"省", "市", "县", "区"}
    pq = spark.createDataFrame([(0.5, 0.5), (0.5, 0.0), (0.0, 0.5)], "p double, q double")
    r = information.divergences(pq).first()
    assert r.kl == math.inf and r.js == pytest.approx(0.5 * math.log(2))


def test_dataset_map(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id long, text string").repartition(3)
    got = dataset.map_dataset(df, lambda t, i, r, k: {"n": i * k}, "n long", "text", with_indices=True, with_rank=True, order=["id"], fn_kwargs={"k": 2})
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, 2 * i) for i in range(25)] and got.columns == ["id", "text", "n"]
    whole = dataset.map_dataset(df.coalesce(1), lambda b: {"m": [len(b["id"])]}, "m long", remove_columns=["id", "text"], batched=True, batch_size=10, drop_last_batch=True)
    assert [r.m for r in whole.collect()] == [10, 10]
    assert dataset.map_dataset(df, None, remove_columns="text").columns == ["id"]
    assert dataset.map_dataset(df.limit(0), lambda r: {"n": 1}, "n long", shards=2).count() == 0
    for bad in ({"input_columns": "nope"}, {"remove_columns": ["nope"]}, {"shards": 0}):
        with pytest.raises(ValueError):
            dataset.map_dataset(df, lambda r: {}, "n long", **bad)


def test_shards_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(11)], "id long, text string").repartition(3)
    options = {"schema": "n long", "input_columns": "id", "order": ["id"], "shards": 4}
    shard_of = lambda rows: [r.n for r in sorted(rows, key=lambda r: r.id)]
    assert shard_of(dataset.map_dataset(df, lambda i, k: {"n": int(k)}, with_rank=True, **options).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert shard_of(dataset.map_dataset(df, lambda i, k: {"n": int(k)}, with_rank=True, **(options | {"shards": 99})).collect()) == list(range(11))
    path = f"{tmp_path}/cache"
    first = dataset.map_dataset(df, lambda i: {"n": i}, cache_path=path, **options)
    assert first.columns == ["id", "text", "n"] and shard_of(first.collect()) == list(range(11))
    spark.createDataFrame([(k,) for k in (0, 1, 3)], f"{dataset.SHARD} int").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
    again = dataset.map_dataset(df, lambda i: {"n": -i}, cache_path=path, **options)  # the third shard is missing
    assert shard_of(again.collect()) == [0, 1, 2, 3, 4, 5, -6, -7, -8, 9, 10]
    batches = dataset.map_dataset(df, lambda b: {"n": [len(b)] * len(b)}, batched=True, batch_size=2, cache_path=f"{tmp_path}/batches", **options)
    assert shard_of(batches.collect()) == [2, 2, 1] * 3 + [2, 2]
    assert dataset.map_dataset(df.limit(0), lambda i: {"n": i}, cache_path=f"{tmp_path}/none", **options).count() == 0
    with pytest.raises(ValueError):
        dataset.map_dataset(df, lambda i: {"n": i}, keep=True, cache_path=path, **options)


def test_chained(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v long") for xs in ([3, 1, 2], [9, 8]))
    c = dataset.Chained([a, b], ["v"])
    assert len(c) == 5 and [c[i].v for i in range(5)] == [1, 2, 3, 8, 9]
    for i in (5, -1):
        with pytest.raises(IndexError):
            c[i]
    assert sorted(tuple(r) for r in c.rows().collect()) == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (8, 0, 1), (9, 1, 1)]


def test_retrieval_and_mmr(spark):
    q = spark.createDataFrame([("q", "x", 2), ("q", "y", 1)], "query_id string, token string, qtf long")
    tf = spark.createDataFrame([(1, "x", 3), (1, "z", 1), (2, "y", 1), (3, "z", 5)], "doc_id long, token string, tf long")
    assert [r.doc_id for r in retrieval.bm25(q, tf).orderBy("rank").collect()] == [1, 2] or [r.doc_id for r in retrieval.bm25(q, tf).orderBy("rank").collect()] == [2, 1]
    assert retrieval.bm25(q, tf, clamp=True, k3=1.2, n=None).count() == 2
    items = spark.createDataFrame([("k", 1, 1.0, [1.0, 0.0]), ("k", 2, 0.9, [1.0, 0.0]), ("k", 3, 0.5, [0.0, 1.0])], "k string, item long, rel double, v array<double>")
    assert [r.item for r in retrieval.mmr(items, "k", "rel", "v", 2).orderBy("rank").collect()] == [1, 3]


def test_topic_model_states(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    f = spark.createDataFrame([(i, Vectors.sparse(4, [(i % 2) * 2, (i % 2) * 2 + 1], [3.0, 2.0])) for i in range(20)], ["doc_id", "features"])
    m = topics.TopicModel(2, seed=3, chunk_share=0.5)
    with pytest.raises(RuntimeError):
        m.transform(f)
    m.fit(f)
    with pytest.raises(RuntimeError):
        m.fit(f)
    vocab = spark.createDataFrame([(i, w, 10) for i, w in enumerate("abcd")], "token_id long, token string, df long")
    sums = {r.topic: r.s for r in m.topic_word(vocab).groupBy("topic").agg(F.sum("p").alias("s")).collect()}
    assert all(s == pytest.approx(1) for s in sums.values()) and topics.clusters(m.transform(f)).count() == 20
    m.save(f"{tmp_path}/m")
    assert topics.TopicModel.load(f"{tmp_path}/m").transform(f).count() == 40
    assert math.isfinite(m.log_perplexity(f)) and m.partial_fit(f, f).model is not None


def test_matrices(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 3, (4, 5)), rnd.integers(0, 3, (5, 3))
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row int, col int, v double")
    got = np.zeros((4, 3))
    for r in matrix.multiply(long(a), long(b)).collect():
        got[r.row, r.col] = r.v
    assert (got == a @ b).all()
    assert all(r.v == pytest.approx(1) for r in matrix.row_sums(matrix.normalized(long(a))).collect())
    assert matrix.merged(long(a), matrix.transposed(matrix.transposed(long(a)))).where("a <> b").count() == 0


def test_vector_measures(spark):
    x = np.eye(3)
    assert metrics.matched_overlap(x, x) == pytest.approx(1) and metrics.matched_overlap(x[:1], x[1:2]) == 0
    top = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "c")], "topic int, rank int, token string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "token string, vector array<double>")
    assert {r.topic: round(r.c_w2v, 9) for r in metrics.c_w2v(top, vectors).collect()} == {0: 1.0, 1: 0.0}
    r = metrics.embedding_overlap(top, vectors).first()
    assert r.overlap == pytest.approx((1 + (1 + 0) / 2) / 2) and r.inverted == pytest.approx(1 - r.overlap)
