"""Sentence graphs of many documents at once."""

import random

import numpy as np
import pyarrow as pa
from lexmill.functions import tokens as K
from lexmill.functions.clean import STEPS, _phones, clean, strip
from lexmill.functions.split import MARKS, listed, sentences
from lexmill.operators import batches, graph, summary, textrank
from pyspark.sql import functions as F
from test_operators import dense

ODD = [(1, None), (2, ""), (3, "Solo"), (4, "Alpha beta gamma. Beta gamma delta! Gamma delta alpha? Six."), (5, "12. 34"), (6, "the and of. is. 12 rain")]


def test_weights_of_documents_need_no_shuffle(spark):
    rnd = random.Random(5)
    rows = [(d, [[rnd.choice("abcdef") for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(7))]) for d in range(60)]
    df = spark.createDataFrame([*rows, (100, None)], "doc_id long, sents array<array<string>>").coalesce(2)
    got = textrank.bm25_document_weights(df, F.col("sents"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for x in (got, textrank.bm25_document_weights(df.unionByName(spark.createDataFrame([(101, [["a"]]), (101, None)], df.schema)), F.col("sents")).where("doc_id < 100")):
        found = {(r.doc_id, r.idx): r.weight for r in x.collect()}
        assert len(found) == sum(bool(s) for _, sents in rows for s in sents)
        for d, sents in rows:
            at = [i for i, s in enumerate(sents) if s]
            want = dense([sents[i] for i in at]).sum(axis=1) if at else []
            assert np.allclose([found[d, i] for i in at], want)


def test_graphs_together_are_each_alone():
    rnd = random.Random(6)
    docs = [[[rnd.choice("abcdefgh") for _ in range(rnd.randrange(8))] for _ in range(rnd.randrange(12))] for _ in range(80)]
    code = np.array([ord(t) for d in docs for s in d for t in s], np.int64)
    for signed, rounds in ((False, 200), (True, 200), (False, 3)):
        s, order = graph.SentenceGraphs(np.array([len(d) for d in docs]), np.array([len(s) for d in docs for s in d]), code).rank(signed=signed, max_iter=rounds)
        alone = [graph.SentenceGraph(d).rank(signed=signed, max_iter=rounds) for d in docs]
        assert s.tolist() == [x for a, _ in alone for x in a.tolist()] and order.tolist() == [x for _, o in alone for x in o]


def test_words_are_filtered_as_by_the_columns(spark):
    words = ["the", "der", "rain", "12", "1", "３", "三", "三日", "今天", "12月", "北京市", "市", "monday", "mondays", "january", "x1", "1x", "程序员", "é", "ñandú", "カナ", "한글", "Ⅷ", "½", "nicht", "没有", "a", "五"]
    for script in ("letters", "han", None):
        want = spark.createDataFrame([(words,)], "w array<string>").select(K.filter_tokens(F.col("w"), script=script)).first()[0]
        assert [w for w, k in zip(words, K.kept_words(pa.array(words), script), strict=True) if k] == want


def test_ranks_of_a_batch_are_those_of_each_document(spark):
    """No word is filtered where it stands: the plan holds no filter for each token, and the results are the same."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    got = textrank.sentence_ranks(docs, "latin_coarse", keep=["doc_id"])
    assert "january" not in got._jdf.queryExecution().executedPlan().toString()
    tokens = F.transform(F.filter(F.transform(sentences(clean(F.col("text")), "latin_coarse"), strip), lambda s: s != ""), lambda s: K.filter_tokens(K.tokenize(s), script="letters"))
    summaries = {r.doc_id: r.summary for r in textrank.summarize(docs, 2, "latin_coarse").collect()}
    for r, own in zip(got.orderBy("doc_id").collect(), docs.select("doc_id", tokens.alias("t"), sentences(F.col("text"), "latin_coarse").alias("s")).orderBy("doc_id").collect(), strict=True):
        s, order = graph.SentenceGraph(own.t or []).rank()
        assert r.scores == s.tolist() and r.ranks == order
        assert summaries[r.doc_id] == "".join(own.s[i].strip() for i in order[:2])


def test_sentence_weights_do_not_depend_on_which_words_are_common(spark):
    """Words are weighed in place or by the join; tokens of documents are shuffled in neither case."""
    rnd = random.Random(7)
    rows = [(d, " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) + rnd.choice(["", "", ".", "!"]) for _ in range(rnd.randrange(60)))) for d in range(40)]
    docs = spark.createDataFrame([*rows, (100, None), (101, "12. 34")], "doc_id long, text string")
    idf, topic = {w * n: rnd.random() for w in "abcdef" for n in (1, 2)}, {w * n: rnd.random() for w in "cdefgh" for n in (2, 3)}
    tables = [spark.createDataFrame(list(x.items()), "token string, weight double") for x in (idf, topic)]
    sents = summary.kept_sentences(docs, "latin_coarse", cleaned=False)
    want = {}
    for r in sents.collect():
        tokens = [t for s in r.sents or [] for t in s.tokens]
        for i, s in enumerate(r.sents or []):
            w = [0.2 * topic.get(t, 0.4) + tokens.count(t) / len(tokens) * idf.get(t, 0.3) for t in s.tokens]
            want[r.doc_id, i] = sum(w) / len(w) * (1 if 15 <= len(s.sentence) <= 70 else 0.7) * (1.2 if i < 3 else 1)
    for most in (0, 5, 1000):
        found = summary.document_weights(sents, *tables, 0.3, 0.4, keep=["doc_id"], most=most)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.columns == ["doc_id", "weights"] and "sentences" not in plan and "tokens" not in plan
        got = {(r.doc_id, i): w for r in found.collect() for i, w in enumerate(r.weights)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    none = [x.where("false") for x in tables]
    assert summary.document_weights(sents, *none).count() == 42 and {r.weight for r in summary.sentence_weights(sents, *none).collect()} == {0.0}


def test_counts_by_label_are_summed_before_they_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "x", "a b a"), (2, "x", "a"), (3, None, "a c"), (4, "y", None), (5, None, "c c")], "doc_id long, topic string, text string").coalesce(1)
    got = batches.label_counts(docs, "topic", K.tokenize(F.col("text")))
    assert {tuple(r) for r in got.collect()} == {("x", "a", 2, 3), ("x", "b", 1, 1), (None, "a", 1, 1), (None, "c", 2, 3)}


def test_short_ways_of_cleaning_and_splitting_are_the_long_ones(spark):
    """Latin-1 texts are cleaned, and texts without quotes split, by patterns of their own."""
    rnd = random.Random(8)
    signs = [*"ab1+.,!?\n\r\t  -()[]{}<>@&#\x00\x1f\x7f\xa0\xad\x85éß", "“", "”", "…", "，", "。", "（", "）", "　", "Ａ", "\u200b", "&amp;", "13812345678", "0123-4567890", "+49 301 2345678", "www.a.b", "a@b.cd", "http://x.y"]
    texts = [(i, "".join(rnd.choices(signs[: 36 if i % 2 else None], k=rnd.randrange(40)))) for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(texts, "i long, text string")
    long = F.col("text")
    for s in (STEPS | {"phones": _phones}).values():
        long = s(long)
    three = lambda c: "(?<=[{0}])(?=“)|(?<=[{1}])(?=[^{0}])|(?<=[{0}]”)(?=[^{0}])".format(listed(c), listed(c.replace("“", "").replace("”", "")))
    assert df.where(~clean(F.col("text")).eqNullSafe(long)).count() == 0
    for name, chars in MARKS.items():
        assert df.where(~sentences(F.col("text"), name).eqNullSafe(F.filter(F.split("text", three(chars), -1), lambda s: s != ""))).count() == 0
