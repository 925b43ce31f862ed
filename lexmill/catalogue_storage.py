"""Queries whose tables go through a file format, a stored model or shards and back, and those of single formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill import catalogue as Q
from lexmill.catalogue import docs, joined, query, r6, table
from lexmill.operators import dataset, graph, metrics, phrases, terms, textrank, topics
from lexmill.plans import sql as S
from lexmill.plans.corpus import tokenized
from lexmill.plans.storage import new_folder
from lexmill.sources import corpus

# -- sources and sinks -----------------------------------------------------------------------


@query("jsonl_round_trip", "select doc_id, lang, source, text from documents")
def _(s, d):
    path = new_folder(s)
    table(s, d, "documents").select("doc_id", "lang", "source", "text").write.json(path)
    return corpus.read_jsonl(s, path, "doc_id long, lang string, source string, text string")


@query("dataset_overwrite", "select doc_id, text from documents")
def _(s, d):
    """The second table replaces the first."""
    path, df = new_folder(s), table(s, d, "documents")
    corpus.write_dataset(df.select("doc_id", "lang"), path)
    corpus.write_dataset(df.select("doc_id", "text"), path)
    return corpus.read_dataset(s, path, "doc_id long, text string")


@query("read_many_datasets", "select doc_id, text from documents union all select item_id, text from benchmark")
def _(s, d):
    paths = [f"{new_folder(s)}/{n}" for n in ("documents", "benchmark")]
    for path, df in zip(paths, (table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")), strict=True):
        corpus.write_dataset(df, path)
    return corpus.read_many(s, paths, "doc_id long, text string")


@query("vocabulary_round_trip", f"with {Q._VOCAB} select * from vocab")
def _(s, d):
    path = new_folder(s)
    corpus.write_vocabulary(Q._vocab(s, d), path)
    return corpus.read_vocabulary(s, path)


@query("matrix_market_round_trip", f"with {Q._VOCAB} select doc_id, token_id, cast(tf as double) weight from tf join vocab using (token)")
def _(s, d):
    path = new_folder(s)
    corpus.write_matrix_market(Q._bow(s, d), path)
    return corpus.read_matrix_market(s, path)


@query("svmlight_round_trip", f"with {Q._VOCAB} select count(*) n_terms, cast(sum(tf) as double) n_tokens, min(token_id) first_id, max(token_id) last_id from tf join vocab using (token) group by doc_id")
def _(s, d):
    """A row for each document, which the format does not name: what its vector holds, by the sparse vector's own arrays."""
    path, tf = new_folder(s), Q.cut(Q._tf(s, d))
    vocab = Q.cut(terms.vocabulary(*Q._df(s, d, tf)))
    corpus.write_svmlight(terms.bag_of_words(tf, vocab), path)
    read = corpus.read_svmlight(s, path, max(1, vocab.count())).select(F.unwrap_udt("features").alias("v")).select("v.indices", "v.values")
    read = read.select("values", F.transform(F.filter(F.arrays_zip("indices", "values"), lambda x: x["values"] != 0), lambda x: x["indices"]).alias("k"))
    return read.select(F.size("k").cast("long").alias("n_terms"), F.aggregate("values", F.lit(0.0), lambda t, x: t + x).alias("n_tokens"), F.array_min("k").cast("long").alias("first_id"), F.array_max("k").cast("long").alias("last_id"))


@query("weight_object_round_trip", f"with {S.IDF} select row_number() over (order by round(weight, 9), token) - 1 place, token, {S.r6('weight')} weight from idf")
def _(s, d):
    """A JSON object by rising weight; place is a token's place in it."""
    path = new_folder(s)
    corpus.write_weight_object(Q._idf(s, d).withColumn("weight", F.round("weight", 9)), path)
    return corpus.read_weights(s, path).select(F.col("place").cast("long").alias("place"), "token", r6("weight").alias("weight"))


@query("weight_lines_round_trip", f"with {S.IDF} select token, {S.r6('weight')} weight from idf")
def _(s, d):
    path = new_folder(s)
    corpus.write_weights(Q._idf(s, d), path)
    return corpus.read_weight_lines(s, path).select("token", r6("weight").alias("weight"))


@query(
    "mining_round_trip",
    f"""with {S.TOPIC} select 'topic_word' kind, topic a, token b, {S.r6('p')} v from tw union all select 'doc_topic', cast(doc_id as varchar), topic, 1.0 from lab
    union all select 'lengths', cast(doc_id as varchar), null, cast(sum(tf) as double) from tf group by doc_id""",
)
def _(s, d):
    tw, dt, ln, _, _ = Q._topic_tables(s, d)
    path = new_folder(s)
    corpus.write_mining(path, tw, dt, ln)
    read = corpus.read_mining(s, path)
    out = read["topic_word"].select(F.lit("topic_word").alias("kind"), F.col("topic").alias("a"), F.col("token").alias("b"), r6("p").alias("v"))
    out = out.unionByName(read["doc_topic"].select(F.lit("doc_topic").alias("kind"), F.col("doc_id").cast("string").alias("a"), F.col("topic").alias("b"), F.col("p").alias("v")))
    return out.unionByName(read["lengths"].select(F.lit("lengths").alias("kind"), F.col("doc_id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("length").cast("double").alias("v")))


@query("lda_save_load", f"with {Q._VOCAB} select doc_id, 10 n_topics, 0.0 difference from (select distinct doc_id from tf join vocab using (token))")
def _(s, d):
    """The topics of each document by a model and by the same model after it was saved and loaded."""
    features, _ = Q._features(s, d)
    path, model = new_folder(s), topics.TopicModel(10, seed=1).fit(features)
    model.save(path)
    both = model.transform(features).alias("x").join(topics.TopicModel.load(path).transform(features).alias("y"), ["doc_id", "topic"])
    return both.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_topics"), r6(F.max(F.abs(F.col("x.p") - F.col("y.p")))).alias("difference"))


# -- datasets --------------------------------------------------------------------------------

_SHARDS = 7
_SHARD_SQL = f"select doc_id, i, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end shard from (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () // {_SHARDS} q, count(*) over () % {_SHARDS} r from documents)"


def _sharded(s, d, **options) -> DataFrame:
    """Each document with its row number and shard, as the mapped function sees them."""
    return dataset.map_dataset(table(s, d, "documents").select("doc_id"), lambda x, i, k: {"i": int(i), "shard": int(k)}, "i long, shard long", "doc_id", with_indices=True, with_rank=True, order=["doc_id"], shards=_SHARDS, **options)


query("dataset_map_identity", "select doc_id, text from documents")(lambda s, d: dataset.map_dataset(table(s, d, "documents"), None, remove_columns=[c for c in table(s, d, "documents").columns if c not in ("doc_id", "text")]))
query("dataset_map_columns", "select doc_id, lang || ':' || source both_names from documents")(
    lambda s, d: dataset.map_dataset(docs(s, d).select("doc_id", "lang", "source"), lambda a, b: {"both_names": f"{a}:{b}"}, "both_names string", input_columns=["lang", "source"], remove_columns=["lang", "source"])
)
query("dataset_map_shards", _SHARD_SQL)(lambda s, d: _sharded(s, d))
query("dataset_map_cached", _SHARD_SQL)(lambda s, d: (lambda path: (_sharded(s, d, cache_path=path), _sharded(s, d, cache_path=path))[1])(new_folder(s)))
query(
    "tokens_of_two_columns",
    f"""with {S.cleaned('documents', 'doc_id', 'source', 'cs')}, {S.cleaned('documents', 'doc_id', 'text', 'ct')}, w as (select doc_id, {S.words('cs.text')} a, {S.words('ct.text')} b from cs join ct using (doc_id))
    select doc_id, array_to_string(list_filter(a || b, lambda w: length(w) between 2 and 6 and {Q._FILTERS}), ' ') tokens from w""",
)(lambda s, d: tokenized(docs(s, d), ("source", "text")).select("doc_id", joined("tokens").alias("tokens")))

# -- graphs, phrases, places, judgements -----------------------------------------------------


@query(
    "pagerank_node_weights",
    f"""with l as (select 'page:' || url src, 'href:' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) dst from pages), e as materialized (select src, dst, count(*) w from (select src, dst from l union all select dst, src from l) group by all),
    o as (select src, sum(w) total from e group by 1), h as materialized (select src, dst, w / total share from e join o using (src)), v as materialized (select src node, length(src) / sum(length(src)) over () t from o),
    {S.rounds(10, "select node, t score from v", "select node, 0.15 * t + 0.85 * coalesce(got, 0) score from v left join (select dst, sum(share * score) got from h join {prev} on src = node group by 1) on dst = node")}
    select node, round(score, 9) + 0.0 score from s10""",
)
def _(s, d):
    """Teleport by given weights of the nodes, here the lengths of their names."""
    links = corpus.page_links(table(s, d, "pages"))
    weights = links.select(F.col("src").alias("node")).distinct().select("node", F.length("node").cast("double").alias("weight"))
    return graph.page_rank_table(links, weights=weights).withColumn("score", F.round("score", 9) + 0.0)


@query(
    "textrank_sentences_k10",
    f"""with st as (select doc_id, unnest(range(len(s))) idx, unnest(s) sentence from (select doc_id, list_filter(list_transform({S.sentences('text', 'latin_coarse')}, lambda x: {{STRIP}}), lambda x: x <> '') s from documents)),
    w as materialized (select doc_id, idx, list_filter({S.words('sentence')}, lambda w: {Q._FILTERS}) w from st), z as (select doc_id, count(*) n, avg(len(w)) mean from w group by 1),
    kk as (select doc_id, idx, n, 1.5 * (0.25 + 0.75 * len(w) / case when mean = 0 then 1 else mean end) k from w join z using (doc_id)), c as materialized (select doc_id, idx, token, count(*) f from (select doc_id, idx, unnest(w) token from w) group by all),
    df as (select doc_id, token, count(*) df from c group by all),
    g as materialized (select x.doc_id, x.idx i, y.idx j, sum(x.f * (ln(n - df + 0.5) - ln(df + 0.5)) * y.f * 2.5 / (y.f + k)) w from c x join c y on x.doc_id = y.doc_id and x.token = y.token and x.idx <> y.idx join kk on kk.doc_id = x.doc_id and kk.idx = x.idx join df on df.doc_id = x.doc_id and df.token = x.token group by all),
    cs as materialized (select doc_id, j, sum(w) total from g group by all), h as materialized (select doc_id, i, j, case when total = 0 then 0 else w / total end share from g join cs using (doc_id, j)),
    {S.rounds(10, "select doc_id, idx, 1.0 score from w", "select w.doc_id, w.idx, 0.15 + 0.85 * coalesce(got, 0) score from w left join (select h.doc_id, i, sum(share * score) got from h join {prev} p on p.doc_id = h.doc_id and p.idx = h.j group by all) x on x.doc_id = w.doc_id and x.i = w.idx")}
    select doc_id, idx, {S.r6('score')} score from s10""".replace("{STRIP}", "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"),
)
def _(s, d):
    found = textrank.sentence_ranks(docs(s, d), "latin_coarse", max_iter=10, min_diff=0.0, cleaned=False, keep=["doc_id"])
    return found.select("doc_id", F.posexplode("scores").alias("idx", "score")).select("doc_id", F.col("idx").cast("long").alias("idx"), r6("score").alias("score"))


_GONE, _GONE_PHRASES = ["onou", "ha"], ["ch", "data", "model"]
query("phrase_removed_words", f"with {Q._PHRASES} select doc_id, sent, pos, n, phrase, {S.r6('score')} score from scored where not list_has_any(list_transform(p, lambda x: x.token), [{', '.join(map(S.quote, _GONE))}]) and not {S.among('phrase', _GONE_PHRASES)}")(
    lambda s, d: Q._long(Q._scored(s, d, remove_words=_GONE, remove_phrases=_GONE_PHRASES), "sent", "pos", "n")
)
query("gazetteer", "select n_name place from nation union select r_name from region")(lambda s, d: terms.gazetteer(table(s, d, "nation").select(F.col("n_name").alias("place")), table(s, d, "region").select(F.col("r_name").alias("place"))))


@query("gazetteer_flatten", "select r_name place from region union select n_name from nation union select distinct c_mktsegment from customer")
def _(s, d):
    """Region, nation and the nation's market segments as a tree of one row for each region."""
    segments = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("segments"))
    cities = table(s, d, "nation").join(segments, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.coalesce("segments", F.array().cast("array<string>"))))).alias("cities"))
    return terms.flatten_gazetteer(table(s, d, "region").join(cities, "r_regionkey").select(F.create_map("r_name", "cities").alias("tree")))


@query(
    "human_judgements",
    f"with p as (select lang, count(*) / sum(count(*)) over () p from documents group by 1), m as (select max(p) top from p) select source, {S.r6('avg(case when quality = 1 then 1.0 else 0.0 end)')} word_intrusion, {S.r6('avg(ln(p.p) - ln(m.top))')} topic_intrusion from documents join labels using (doc_id) join p using (lang), m group by 1",
)
def _(s, d):
    """The two formulas, with labels as subjects' answers and languages as topics."""
    df = table(s, d, "documents").select("doc_id", "lang", "source")
    shares = df.groupBy("lang").count().withColumn("n", F.sum("count").over(Window.partitionBy())).select("lang", (F.col("count") / F.col("n")).alias("p"), (F.max("count").over(Window.partitionBy()) / F.col("n")).alias("top"))
    judged = df.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id").join(F.broadcast(shares), "lang")
    return judged.groupBy("source").agg(r6(metrics.word_intrusion(F.col("quality") == 1)).alias("word_intrusion"), r6(metrics.topic_intrusion(F.col("p"), F.col("top"))).alias("topic_intrusion"))
