"""Many documents in a few array operations, against one document at a time."""

import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from lexmill import catalogue
from lexmill.functions import clean
from lexmill.operators import batches, graph, metrics, phrases, terms, topics
from lexmill.sources import corpus
from pyspark.ml.clustering import LDAModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

TEXTS = [(1, "b a b c d e a"), (2, ""), (3, None), (4, "x x x"), (5, "ü z a \U00010400 z é"), (6, "one"), (7, " ".join("pqrst"[i * i % 5] for i in range(40)))]


def loop_edges(tokens, window=4):
    return {(min(t, u, key=str.encode), max(t, u, key=str.encode)) for i, t in enumerate(tokens) for u in tokens[i + 1 : i + 1 + window] if t != u}


def split(c="text"):
    return F.filter(F.split(c, " "), lambda t: t != "")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_edges_and_degrees_of_a_row_in_one_pass(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    edges, degrees = graph.edges_of(df, split()), graph.degrees_of(df, split())
    assert shuffles(edges) == shuffles(degrees) == 0  # pairs are not shuffled
    want = {(d, *e) for d, t in TEXTS for e in loop_edges((t or "").split())}
    rows = [tuple(r) for r in edges.collect()]
    assert set(rows) == want and len(rows) == len(want)
    by_token = Counter((d, t) for d, a, b in want for t in (a, b))
    assert {(r.doc_id, r.token): r.degree for r in degrees.collect()} == by_token


def test_rows_that_share_a_key_meet(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b a c"), (2, "a b"), (None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, graph.edges_of(df, split()).where("doc_id = 1").collect())) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]
    assert graph.edges_of(df, split()).where("doc_id is null").count() == 1
    assert {(r.doc_id, r.token): r.degree for r in graph.degrees_of(df, split()).collect()}[1, "a"] == 2


def test_pieces_hold_all_rows_and_few_tokens():
    batch = pa.RecordBatch.from_pydict({"t": [["a"] * n for n in (0, 3, 0, 9, 1, 1, 1, 0)]})
    parts = list(batches.pieces(batch, batches.lengths(batch.column(0)), 4))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.num_rows for p in parts) <= 4


@pytest.mark.parametrize("rules", [{}, {"strict": False}, {"strict": False, "max_window": 3, "allow_place": False}, {"specified": ["bb", "e"]}, {"remove_words": ["bb"], "remove_phrases": ["a c"]}, {"max_chars": 4}])
def test_ngrams_of_a_pass_are_the_candidates(spark, monkeypatch, rules):
    rnd, tags = random.Random(8), {"a": "n", "bb": "a", "c": "ns", "dd": "nr", "e": "v", "ff": "u", "時": "n", "de": "n"}
    tagger = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]), t), F.lit("n"))
    docs = spark.createDataFrame([(d, ". ".join(" ".join(rnd.choice(list(tags)) for _ in range(rnd.randrange(9))) for _ in range(4))) for d in range(12)] + [(99, None), (98, "")], "doc_id long, text string")
    idf, topic = spark.createDataFrame([("a", 1.0), ("bb", 3.0)], "token string, weight double"), spark.createDataFrame([("a", 0.5), ("c", 0.25)], "token string, weight double")
    found = phrases.weighted_sentences(docs, idf, topic, criterion="latin_fine", tagger=tagger)
    want = sorted((*r[:5], round(r.score, 9)) for r in phrases.phrase_scores(phrases.candidates(phrases.weighted_tokens(found), **rules)).drop("p").collect())
    scored, plain = phrases.ngrams(found, **rules), phrases.ngrams(phrases.tagged_words(docs, "latin_fine", tagger), **rules)
    assert sorted((*r[:5], round(r.score, 9)) for r in scored.collect()) == want and want
    assert sorted(map(tuple, plain.collect())) == [r[:5] for r in want] and shuffles(plain) == 0  # without scores no weights are made


def test_phrases_of_many_different_tokens_are_compared_too(spark):
    """Single letters give n-grams of more than FEW different tokens."""
    letters = "bcfgjkpqvwxz"
    rnd = random.Random(2)
    docs = [(d, ". ".join(" ".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(3))) for d in range(20)] + [(50, "river stone. stone river water")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "token string, weight double")
    rows = phrases.phrase_scores(phrases.candidates(phrases.weighted_tokens(phrases.weighted_sentences(df, none, none, 1.0, 0.5, criterion="latin_fine")))).orderBy("doc_id", "sent", "pos", "n").collect()
    got = phrases.key_phrases(df, none, none, 1.0, 0.5, top_k=None, criterion="latin_fine").orderBy("doc_id", "rank").collect()
    for d, _ in docs:
        own = [([x.token for x in r.p], r.phrase, r.score) for r in rows if r.doc_id == d]
        assert [(r.phrase, round(r.score, 9)) for r in got if r.doc_id == d] == [(p, round(x, 9)) for p, x in phrases.without_overlap(own, None)]


def test_counts_of_a_row_in_one_pass(spark):
    df = spark.createDataFrame([(d, t, "s") for d, t in TEXTS], "doc_id long, text string, topic string")
    tf = terms.row_frequency(df, split(), "topic")
    assert shuffles(tf) == 0 and tf.columns == ["doc_id", "topic", "token", "tf"]
    assert {(r.doc_id, r.token): r.tf for r in tf.collect()} == Counter((d, t) for d, x in TEXTS for t in (x or "").split())
    twice = terms.row_frequency(df.union(df.where("doc_id = 1")), split(), "topic")  # rows of one document meet
    assert {r.token: r.tf for r in twice.where("doc_id = 1").collect()} == {"b": 4, "a": 4, "c": 2, "d": 2, "e": 2}


def test_svmlight_is_read_without_dense_arrays(spark, monkeypatch):
    """The dense array of the whole vocabulary for each document was what took the time."""
    import pyspark.ml.functions

    monkeypatch.setattr(pyspark.ml.functions, "vector_to_array", None)
    rows = catalogue.queries()["svmlight_round_trip"](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence(" not in rows._jdf.queryExecution().toString()


def test_weight_objects_of_any_size_are_written_by_many_tasks(spark, tmp_path):
    """More tokens than the million at which one task's object ended with an error."""
    n = 1_000_100
    corpus.write_weight_object(spark.range(n).select(F.concat(F.lit('w"{'), "id").alias("token"), (F.col("id") % 1000 / 8).alias("weight")), f"{tmp_path}/w")
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    whole = json.loads("".join(p.read_text() for p in files))
    assert len(files) > 1 and len(whole) == n and list(whole.items())[:2] == [('w"{0', 0.0), ('w"{1000', 0.0)]
    read = corpus.read_weights(spark, f"{tmp_path}/w")
    assert read.agg(F.count("*"), F.max("place"), F.count_distinct("place")).first()[:] == (n, n - 1, n)
    ends = {r.place: (r.token, r.weight) for r in read.where(F.col("place").isin(0, 1, 2000, n - 1)).collect()}
    assert ends == {k: list(whole.items())[k] for k in (0, 1, 2000, n - 1)}


def test_weight_objects_of_other_hands(spark, tmp_path):
    for k, text in enumerate(['{"a": 0.5, "ü": 2}', '{\n "a": 0.5,\n "ü": 2\n}', '{"a":\n0.5, "ü"\n: 2}']):
        (tmp_path / f"{k}.json").write_text(text)
        assert sorted(map(tuple, corpus.read_weights(spark, f"{tmp_path}/{k}.json").collect())) == [(0, "a", 0.5), (1, "ü", 2.0)]
    corpus.write_weight_object(spark.createDataFrame([], "token string, weight double"), f"{tmp_path}/none")
    assert corpus.read_weights(spark, f"{tmp_path}/none").count() == 0


def test_perplexity_is_sparks_without_its_sum(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, Vectors.sparse(30, {rnd.randrange(30): float(rnd.randrange(1, 4)) for _ in range(8)})) for i in range(40)] + [(90, Vectors.sparse(30, {})), (91, Vectors.dense([0.0, 2.0, *[0.0] * 28]))]
    f = spark.createDataFrame(rows, ["doc_id", "features"])
    m = topics.TopicModel(3, seed=3, chunk_share=0.5).fit(f)
    want, likely = m.model.logPerplexity(f), m.model.logLikelihood(f)
    monkeypatch.setattr(LDAModel, "logPerplexity", None)  # it takes a table of the vocabulary's size for each document
    assert m.log_perplexity(f) == pytest.approx(want, rel=1e-3) and m.score(f) == pytest.approx(likely, rel=1e-3)
    x = [0.05, 0.5, 3.0, 700.0]
    assert topics.log_gamma(x).tolist() == pytest.approx([math.lgamma(v) for v in x], rel=1e-10)
    assert topics.digamma(x).tolist() == pytest.approx([(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], rel=1e-6)


def test_word_vectors_are_trained_by_several_tasks(spark, monkeypatch):
    seen, init = [], metrics.Word2Vec
    monkeypatch.setattr(metrics, "Word2Vec", lambda **o: (seen.append(o["numPartitions"]), init(**o))[1])
    df = spark.createDataFrame([(["a", "b", "c", "a"],)] * 25, "tokens array<string>")
    assert {r.token for r in metrics.word_vectors(df, docs_each=10).collect()} == {"a", "b", "c"} and seen == [3]
    assert metrics.word_vectors(df).count() == 3 and seen == [3, 1]


def test_cleaning_with_and_without_what_it_looks_for(spark):
    texts = ["plain", None, "", "a<b>c", "a < b", "x &amp;lt; y", "ＡＢ　ｃ", "call 13812345678 or 010-1234567.", "010)13812345678 12345678", "+1 212 5551234 x", "(010)12345678", "http://a.b/c www.x.y z", "://", "a@b.cc @"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    plain = F.regexp_replace(t, clean.TAG, "")
    for entity, char in clean.ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.regexp_replace(F.translate(plain, clean.FULL, clean.HALF), clean.URL, "")
    plain = F.concat(F.lit(clean.SENTINEL), F.regexp_replace(plain, clean.EMAIL, ""), F.lit(clean.SENTINEL))
    for p in (clean.MOBILE, clean.MOBILE, clean.LANDLINE, clean.LANDLINE):
        plain = F.regexp_replace(plain, p, "$1$2")
    got = df.select(clean.clean(t, ("tags", "entities", "width", "urls", "emails", "phones")).alias("x"), F.substring(plain, F.lit(2), F.length(plain) - 2).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and got[1].x is None
