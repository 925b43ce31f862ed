"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import clean as C
from lexmill.functions import lists
from lexmill.functions import tokens as K
from lexmill.functions.split import sentences
from lexmill.operators import batches, dataset, graph, information, matrix, metrics, phrases, retrieval, summary, terms, textrank, topics
from lexmill.plans import sql as S
from lexmill.plans.corpus import tokenized
from lexmill.plans.storage import cut
from lexmill.sources.corpus import page_links, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    from lexmill import catalogue_storage  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def joined(c: Column | str) -> Column:
    return F.array_join(c, " ")


# -- cleaning and splitting ------------------------------------------------------------------

query("clean_html_strip", f"select page_id, {S.step('tags', 'html')} as text from pages")(lambda s, d: table(s, d, "pages").select("page_id", C.strip_tags(F.col("html")).alias("text")))
query("html_unescape_common", f"select page_id, {S.step('entities', 'html')} as text from pages")(lambda s, d: table(s, d, "pages").select("page_id", C.unescape_common(F.col("html")).alias("text")))
query("html_unescape_full")(lambda s, d: table(s, d, "pages").select("page_id", C.unescape(C.strip_tags(F.col("html"))).alias("text")))
for _name, _step in {"clean_odd_chars": "odd", "clean_full_width": "width", "clean_redundant_chars": "runs", "clean_brackets": "brackets", "clean_url": "urls", "clean_email": "emails", "clean_phone": "phones"}.items():
    query(_name, f"select doc_id, {S.step(_step, 'text')} as text from documents")(lambda s, d, f=C.STEPS[_step]: docs(s, d).select("doc_id", f(F.col("text")).alias("text")))
query("clean_pipeline", f"with {S.cleaned('documents', 'doc_id', 'text')} select doc_id, text from cleaned")(lambda s, d: docs(s, d).select("doc_id", C.clean(F.col("text")).alias("text")))
query("clean_pages", f"with {S.cleaned('pages', 'page_id', 'html')} select page_id, text from cleaned")(lambda s, d: table(s, d, "pages").select("page_id", C.clean(F.col("html")).alias("text")))
query("markdown_dollars", "select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when starts_with(x, '$') then x else replace(x, '$', '$$') end), chr(10)) as text from documents")(
    lambda s, d: docs(s, d).select("doc_id", C.double_dollars(F.col("text")).alias("text"))
)


def _split_sql(criterion: str) -> str:
    return f"select doc_id, unnest(range(len(s))) idx, unnest(s) sentence from (select doc_id, {S.sentences('text', criterion)} s from documents)"


for _name, _criterion in {"split_coarse": "latin_coarse", "split_fine": "latin_fine", "split_han_coarse": "coarse", "split_han_fine": "fine"}.items():
    query(_name, _split_sql(_criterion))(lambda s, d, c=_criterion: terms.document_sentences(docs(s, d), c).withColumn("idx", F.col("idx").cast("long")))


@query("sentence_stats", f"with s as ({_split_sql('latin_coarse')}) select doc_id, count(*) n_sentences, {S.r6(f'avg(len({S.words("sentence")}))')} avg_tokens, max(length(sentence)) max_chars from s group by 1")
def _(s, d):
    return terms.sentence_statistics(terms.document_sentences(docs(s, d), "latin_coarse")).select("doc_id", "n_sentences", r6("avg_tokens").alias("avg_tokens"), F.col("max_chars").cast("long").alias("max_chars"))


# -- tokens ----------------------------------------------------------------------------------


def _tokens_query(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """doc_id, n_tokens and the tokens that f keeps; sql is its condition on w."""
    query(name, f"select doc_id, len(w) n_tokens, array_to_string(w, ' ') tokens from (select doc_id, list_filter({S.words('text')}, lambda w: {sql}) w from documents)")(
        lambda s, d: docs(s, d).select("doc_id", f(K.tokenize(F.col("text"))).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), joined("w").alias("tokens"))
    )


_POSITIVE = sorted(set(lists.ALL_STOP_WORDS) - set(lists.ALL_NEGATIVE))
_tokens_query("tokenize", lambda w: w, "true")
_tokens_query("token_length_filter", K.of_length, "length(w) between 2 and 6")
_tokens_query("negative_words_kept", lambda w: K.drop_stop_words(w, keep_negative=True), f"not {S.among('w', _POSITIVE)}")
_tokens_query("time_filter", K.drop_times, f"not {S.whole('w', lists.TIME)}")
_tokens_query("number_filter", K.drop_numbers, f"not {S.whole('w', lists.NUMBER)}")
_tokens_query("place_pattern_filter", K.drop_places, f"not {S.whole('w', lists.PLACE)}")
_tokens_query("script_filter", lambda w: K.keep_script(w, "letters"), r"regexp_matches(w, '\p{L}')")
_FILTERS = rf"not {S.among('w', lists.ALL_STOP_WORDS)} and not {S.whole('w', lists.TIME)} and not {S.whole('w', lists.PLACE)} and not {S.whole('w', lists.NUMBER)} and regexp_matches(w, '\p{{L}}')"
_tokens_query("token_filters", lambda w: K.filter_tokens(w, script="letters"), _FILTERS)


@query("stopword_anti_join", f"with {S.TOK} select doc_id, count(*) n, count(distinct token) n_distinct from tok where not {S.among('token', lists.ALL_STOP_WORDS)} group by 1")
def _(s, d):
    stop = s.createDataFrame([(w,) for w in lists.ALL_STOP_WORDS], "token string")
    kept = terms.document_tokens(docs(s, d)).join(F.broadcast(stop), "token", "left_anti")  # a fixed list of some hundred words
    return terms.term_frequency(kept).groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_distinct"))


@query("place_gazetteer_filter", f"with {S.TOK}, g as (select lower(n_name) place from nation union select lower(r_name) from region) select doc_id, count(*) n from tok where token not in (select place from g) group by 1")
def _(s, d):
    places = terms.gazetteer(table(s, d, "nation").select(F.lower("n_name").alias("place")), table(s, d, "region").select(F.lower("r_name").alias("place")))
    return terms.document_tokens(docs(s, d)).join(places, F.col("token") == F.col("place"), "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("conversation_tokens", f"select conv_id, turn, len(w) n_tokens, array_to_string(w, ' ') tokens from (select conv_id, turn, {S.words('text')} w from conversations)")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", K.tokenize(F.col("text")).alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), joined("w").alias("tokens"))


@query("analyzer", f"with {S.cleaned('documents', 'doc_id', 'text')} select doc_id, array_to_string(list_filter({S.words('text')}, lambda w: length(w) between 2 and 6 and {_FILTERS}), ' ') tokens from cleaned")
def _(s, d):
    return tokenized(docs(s, d)).select("doc_id", joined("tokens").alias("tokens"))


@query("pos_tags", f"with {S.TOK} select token, {S.tag('token')} tag, count(*) n from tok group by 1")
def _(s, d):
    return terms.document_tokens(docs(s, d)).groupBy("token").agg(F.count("*").alias("n")).select("token", K.normal_tag(K.tag(F.col("token"))).alias("tag"), "n")


# -- terms -----------------------------------------------------------------------------------


def _tf(s, d) -> DataFrame:
    return terms.row_frequency(docs(s, d), K.tokenize(F.col("text")))


def _labelled(s, d) -> DataFrame:
    """The same, with the source as the topic where a row is a document."""
    return terms.row_frequency(docs(s, d).withColumnRenamed("source", "topic"), K.tokenize(F.col("text")), "topic")


def _df(s, d, tf: DataFrame | None = None) -> tuple[DataFrame, int]:
    return terms.document_frequency(_tf(s, d) if tf is None else tf), table(s, d, "documents").count()


query("term_frequency", f"with {S.TF} select * from tf")(_tf)
query("relative_tf", f"with {S.TF} select doc_id, token, tf, {S.r6('tf / sum(tf) over (partition by doc_id)')} rel from tf")(lambda s, d: terms.relative_frequency(_tf(s, d)).withColumn("rel", r6("rel")))
query("document_frequency", f"with {S.DF} select * from df")(lambda s, d: terms.document_frequency(_tf(s, d)))


@query("sentence_term_frequency", f"with s as ({_split_sql('latin_coarse')}) select doc_id, idx, token, count(*) tf from (select doc_id, idx, unnest({S.words('sentence')}) token from s) group by all")
def _(s, d):
    sents = terms.document_sentences(docs(s, d), "latin_coarse").withColumn("idx", F.col("idx").cast("long"))
    return terms.term_frequency(terms.explode_tokens(sents, K.tokenize(F.col("sentence")), "doc_id", "idx"), "doc_id", "idx")


_VOCAB = f"{S.DF}, vocab as (select row_number() over (order by token) - 1 token_id, token, df from (select token, df from df, nd where df >= 5 and df <= 0.5 * n order by df desc, token limit 100000))"


@query("vocab_filter_extremes", f"with {_VOCAB} select * from vocab")
def _vocab(s, d):
    df, n = _df(s, d)
    return terms.vocabulary(df, n)




def _bow(s, d) -> DataFrame:
    tf = cut(_tf(s, d))
    return terms.bag_of_words(tf, terms.vocabulary(*_df(s, d, tf)))


query("bow", f"with {_VOCAB} select doc_id, token_id, tf cnt from tf join vocab using (token)")(_bow)
query("doc_lengths", f"with {_VOCAB} select doc_id, cast(sum(tf) as bigint) length from tf join vocab using (token) group by 1")(lambda s, d: terms.doc_lengths(_bow(s, d)))


def _idf(s, d, tf: DataFrame | None = None) -> DataFrame:
    return terms.idf(*_df(s, d, tf))


query("idf_log2", f"with {S.IDF} select token, {S.r6('weight')} weight from idf")(lambda s, d: _idf(s, d).withColumn("weight", r6("weight")))
query("idf_upper_median", f"with {S.IDF} select count(*) n, {S.r6('max(weight) filter (k = c // 2 + 1)')} upper_median from (select weight, row_number() over (order by weight) k, count(*) over () c from idf)")(
    lambda s, d: terms.upper_median(_idf(s, d)).select("n", r6("upper_median").alias("upper_median"))
)
query("weights_minmax", f"with {S.IDF} select token, {S.r6('(weight - min(weight) over ()) / (max(weight) over () - min(weight) over ())')} weight from idf")(lambda s, d: terms.min_max(_idf(s, d)).withColumn("weight", r6("weight")))


@query(
    "tfidf_topk",
    f"with {S.IDF}, sc as (select doc_id, token, tf / sum(tf) over (partition by doc_id) * weight score from tf join idf using (token)), rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, token) rank from sc) select doc_id, token, {S.r6('score')} score, rank from rk where rank <= 5",
)
def _(s, d):
    tf = cut(_tf(s, d))
    found = terms.top(terms.tfidf(tf, _idf(s, d, tf)), 5, ["doc_id"], F.desc(F.round("score", 9)), F.asc("token"))
    return found.select("doc_id", "token", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _lang(s, d, lang: str) -> DataFrame:
    return terms.document_frequency(terms.term_frequency(terms.document_tokens(docs(s, d).where(F.col("lang") == lang))))


_LANG = f"{S.TF}, l as (select lang, token, count(*) df from tf join documents using (doc_id) group by all)"
query("vocab_union", f"with {_LANG} select distinct token from l where lang in ('en', 'de')")(lambda s, d: terms.vocabulary_union(_lang(s, d, "en"), _lang(s, d, "de")))
query("vocab_merge", f"with {_LANG} select token, cast(coalesce(a.df, 0) as double) a, cast(coalesce(b.df, 0) as double) b from (select * from l where lang = 'en') a full join (select * from l where lang = 'de') b using (token)")(
    lambda s, d: terms.merge_vocabularies(_lang(s, d, "en").select("token", F.col("df").cast("double").alias("weight")), _lang(s, d, "de").select("token", F.col("df").cast("double").alias("weight")))
)
query("gazetteer_flatten", "select n_name place from nation union select r_name from region")(
    lambda s, d: terms.gazetteer(table(s, d, "nation").select(F.col("n_name").alias("place")), table(s, d, "region").select(F.col("r_name").alias("place")))
)

# -- retrieval and graphs --------------------------------------------------------------------

_SENTS = f"s as ({_split_sql('latin_coarse')}), st as (select doc_id, idx, {S.words('sentence')} w from s), sk as (select * from st where len(w) > 0)"


@query(
    "bm25_sentence_weights",
    f"""with {_SENTS}, k as (select doc_id, idx, len(w) len, unnest(w) token from sk), c as (select doc_id, idx, len, token, count(*) c from k group by all),
    z as (select doc_id, count(*) n, avg(len(w)) mean from sk group by 1), f as (select doc_id, token, count(*) df from c group by all),
    p as (select x.doc_id, x.idx, x.c * (ln(n - df + 0.5) - ln(df + 0.5)) * y.c * 2.5 / (y.c + 1.5 * (0.25 + 0.75 * x.len / mean)) w from c x join c y on x.doc_id = y.doc_id and x.token = y.token and x.idx <> y.idx join z on z.doc_id = x.doc_id join f on f.doc_id = x.doc_id and f.token = x.token)
    select doc_id, idx, {S.r6('coalesce(sum(p.w), 0)')} weight from sk left join p using (doc_id, idx) group by all""",
)
def _(s, d):
    sents = F.transform(sentences(F.col("text"), "latin_coarse"), lambda x: K.tokenize(x))
    return textrank.bm25_document_weights(docs(s, d), sents).withColumn("weight", r6("weight"))


@query(
    "bm25_retrieval_topk",
    f"""with {S.DF}, ln as (select doc_id, sum(tf) len from tf group by 1), z as (select count(*) n, avg(len) mean from ln), q as (select distinct item_id query_id, unnest({S.words('text')}) token from benchmark),
    p as (select query_id, doc_id, sum(ln((z.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) score from q join df using (token) join tf using (token) join ln using (doc_id), z group by all),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from p) select query_id, doc_id, {S.r6('score')} score, rank from r where rank <= 10""",
)
def _(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(K.tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    return retrieval.bm25(q, cut(_tf(s, d))).select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_EDGES = f"{S.TOK}, off as (select unnest(range(1, 5)) k), e as materialized (select distinct x.doc_id, least(x.token, y.token) a, greatest(x.token, y.token) b from (select doc_id, pos + k pos, token from tok, off) x join tok y on x.doc_id = y.doc_id and y.pos = x.pos where x.token <> y.token)"


def _edges(s, d) -> DataFrame:
    return graph.edges_of(docs(s, d), K.tokenize(F.col("text")))


query("cooccurrence_edges", f"with {_EDGES} select * from e")(_edges)
query("degree_sigmoid", f"with {_EDGES} select doc_id, token, count(*) degree, {S.r6('1 / (1 + exp(-count(*)))')} start from (select doc_id, a token from e union all select doc_id, b from e) group by all")(
    lambda s, d: graph.degrees_of(docs(s, d), K.tokenize(F.col("text"))).withColumn("start", r6("start"))
)


@query(
    "textrank_keywords_k20",
    f"""with {_EDGES}, w as materialized (select doc_id, a i, b j from e union all select doc_id, b, a from e), g as materialized (select doc_id, i j, count(*) deg from w group by all),
    v as materialized (select distinct doc_id, token from tok), {S.rounds(20, "select doc_id, token, 1 / (1 + exp(-coalesce(deg, 0))) score from v left join g on g.doc_id = v.doc_id and g.j = v.token".replace("select doc_id", "select v.doc_id"), "select v.doc_id, v.token, 0.15 + 0.85 * coalesce(x.got, 0) score from v left join (select w.doc_id, w.i, sum(p.score / g.deg) got from w join {prev} p on p.doc_id = w.doc_id and p.token = w.j join g on g.doc_id = w.doc_id and g.j = w.j group by all) x on x.doc_id = v.doc_id and x.i = v.token")},
    r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, token) rank from s20) select doc_id, token, {S.r6('score')} score, rank from r where rank <= 10""",
)
def _(s, d):
    found = textrank.keywords(docs(s, d), 10, max_iter=20, min_diff=0.0, cleaned=False, filtered=False, keep=["doc_id"]).select("doc_id", F.posexplode("keywords").alias("i", "x"))
    return found.select("doc_id", F.col("x.item").alias("token"), r6("x.score").alias("score"), (F.col("i") + 1).cast("long").alias("rank"))


query("textrank_keywords")(lambda s, d: textrank.keywords(docs(s, d), keep=["doc_id"]).select("doc_id", F.transform("keywords", lambda x: x["item"]).alias("keywords")))
query("textrank_sentences")(lambda s, d: textrank.sentence_ranks(docs(s, d), "latin_coarse", keep=["doc_id"]).select("doc_id", "ranks"))
query("textrank_summary")(lambda s, d: textrank.summarize(docs(s, d), criterion="latin_coarse", keep=["doc_id"]))


@query(
    "pagerank_links",
    f"""with l as (select 'page:' || url src, 'href:' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) dst from pages), e as materialized (select src, dst, count(*) w from (select src, dst from l union all select dst, src from l) group by all),
    t as (select src, sum(w) total from e group by 1), h as materialized (select src, dst, w / total share from e join t using (src)), v as materialized (select src node, count(*) over () n from t),
    {S.rounds(10, "select node, 1.0 / n score from v", "select node, 0.15 / n + 0.85 * coalesce(got, 0) score from v left join (select dst, sum(share * score) got from h join {prev} on src = node group by 1) on dst = node")}
    select node, {S.r6('score')} score from s10""",
)
def _(s, d):
    return graph.page_rank_table(page_links(table(s, d, "pages"))).withColumn("score", r6("score"))


# -- summaries and phrases -------------------------------------------------------------------

#: Weights of unknown words: the upper median of the one table, half the mean of the other.
UNKNOWN_IDF = "(select max(weight) filter (k = c // 2 + 1) from (select weight, row_number() over (order by weight) k, count(*) over () c from idf))"
UNKNOWN_PROMINENCE = "(select avg(weight) / 2 from prom)"


def _topic_tables(s, d, tf: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """topic_word, doc_topic, lengths, topics and words with the source as the topic; texts are cut into tokens once."""
    tw, dt, ln = topics.observed(cut(_labelled(s, d)) if tf is None else tf, table(s, d, "documents").select("doc_id", F.col("source").alias("topic")))
    tm = topics.topic_marginals(dt, ln)
    return tw, dt, ln, tm, topics.word_marginals(tw, tm)


def _prominence(s, d, tf: DataFrame | None = None) -> DataFrame:
    tw, _, _, tm, _ = _topic_tables(s, d, tf)
    return terms.min_max(topics.distinctiveness(tw, tm))


def _weights(s, d) -> tuple[DataFrame, DataFrame]:
    """The tables of idf and of topic prominence, from one table: counts by source and token where a row is a document, else term frequencies."""
    df = docs(s, d).withColumnRenamed("source", "topic")
    if not batches.one_row_each(df):
        tf = cut(_labelled(s, d))
        return _idf(s, d, tf), cut(_prominence(s, d, tf))
    counts = cut(batches.label_counts(df, "topic", K.tokenize(F.col("text"))))
    idf = terms.idf(counts.groupBy("token").agg(F.sum("df").alias("df")), table(s, d, "documents").count())
    return idf, cut(terms.min_max(topics.distinctiveness(topics.shares(counts), topics.observed_marginals(counts))))


_SUMMARY = f"""{S.DISTINCT}, idf as (select token, log2(n / df) weight from (select token, count(*) df from tf group by 1), (select count(*) n from documents)), {S.cleaned('documents', 'doc_id', 'text')},
    ss as materialized (select doc_id, unnest(range(len(s))) idx, unnest(s) sentence from (select doc_id, list_filter({S.sentences('text', 'latin_coarse')}, lambda s: regexp_matches(s, '\\p{{L}}')) s from cleaned)),
    stk as (select doc_id, idx, unnest({S.words('sentence')}) token from ss), sc as (select doc_id, token, count(*) tf, sum(count(*)) over (partition by doc_id) total from stk group by doc_id, token),
    sw as (select doc_id, token, tf * coalesce(idf.weight, {UNKNOWN_IDF}) / total tfidf, coalesce(prom.weight, {UNKNOWN_PROMINENCE}) topic from sc left join idf using (token) left join prom using (token)),
    sa as (select doc_id, idx, avg(topic) * 0.2 + avg(tfidf) w from stk join sw using (doc_id, token) group by all),
    sf as (select doc_id, idx, sentence, coalesce(w, 0) * case when length(sentence) between 15 and 70 then 1.0 else 0.7 end * case when idx < 3 then 1.2 else 1.0 end weight from ss left join sa using (doc_id, idx))"""


def _sentence_weights(s, d) -> DataFrame:
    """(doc_id, idx, weight)"""
    found = summary.document_weights(summary.kept_sentences(docs(s, d), "latin_coarse"), *_weights(s, d), keep=["doc_id"])
    return found.select("doc_id", F.posexplode("weights").alias("idx", "weight"))


query("summary_sentence_weights", f"with {_SUMMARY} select doc_id, idx, {S.r6('weight')} weight from sf")(lambda s, d: _sentence_weights(s, d).select("doc_id", F.col("idx").cast("long").alias("idx"), r6("weight").alias("weight")))
_GREEDY = f"""{_SUMMARY}, rk as (select *, row_number() over o rank, sum(length(sentence)) over (o rows unbounded preceding) upto, max(idx) over (partition by doc_id) last from sf window o as (partition by doc_id order by round(weight, 9) desc, idx desc)),
    sp as (select *, max(case when idx = last then rank end) over (partition by doc_id) stop from rk),
    gr as (select doc_id, coalesce(string_agg(sentence, '' order by idx) filter (upto <= 200 and rank <= stop), max(case when rank = 1 then substr(sentence, 1, 200) end)) summary, count(*) filter (upto <= 200 and rank <= stop) n_taken, count(*) n from sp group by 1)"""
query("summary_greedy", f"with {_GREEDY} select doc_id, summary, n_taken from gr")(
    lambda s, d: summary.chosen_sentences(summary.kept_sentences(docs(s, d), "latin_coarse"), *_weights(s, d)).where("n > 0").select("doc_id", "summary", "n_taken")
)
query("summary", f"with {_GREEDY} select doc_id, case when length(text) >= 200 and n > 1 then summary else substr(text, 1, 200) end summary from cleaned left join gr using (doc_id)")(
    lambda s, d: summary.summarize(docs(s, d), *_weights(s, d), criterion="latin_coarse")
)

_CASES = lambda column, weights, other: f"case {column} " + " ".join(f"when {S.quote(k) if isinstance(k, str) else k} then {v}" for k, v in weights.items()) + f" else {other} end"
_PHRASES = f"""{S.DISTINCT}, idf as (select token, log2(n / df) weight from (select token, count(*) df from tf group by 1), (select count(*) n from documents)),
    ps as (select doc_id, unnest(range(len(s))) sent, unnest(s) sentence from (select doc_id, {S.sentences('text', 'latin_fine')} s from documents)),
    pt as (select doc_id, sent, unnest(range(len(w))) pos, unnest(w) token from (select doc_id, sent, {S.words('sentence')} w from ps)),
    pc as (select doc_id, token, count(*) / sum(count(*)) over (partition by doc_id) rel from pt group by doc_id, token),
    pw as (select pt.*, {S.tag('token')} tag, case when {S.among('token', lists.ALL_STOP_WORDS)} then 0.0 else rel * idf.weight end w, prom.weight topic from pt join pc using (doc_id, token) left join idf using (token) left join prom using (token)),
    pl as (select doc_id, sent, list({{'token': token, 'tag': tag, 'w': w, 'topic': topic}} order by pos) a from pw group by all),
    pa as (select doc_id, sent, i - 1 pos, a[i:i + 11] a from (select *, unnest(range(1, len(a) + 1)) i from pl)),
    pr as (select doc_id, sent, pos, a, coalesce(nullif(list_position(list_transform(a, lambda x: {S.among("x.tag", lists.STRICT_TAGS)}), false), 0) - 1, len(a)) r from pa),
    pg as (select doc_id, sent, pos, n, a[1:n] p, array_to_string(list_transform(a[1:n], lambda x: x.token), ' ') phrase from (select *, unnest(range(1, r + 1)) n from pr)),
    cand as (select * from pg where length(phrase) between 1 and 25 and not {S.among('phrase', lists.ALL_STOP_WORDS)} and p[1].tag not in ('v', 'vd', 'vx') and p[-1].tag not in ('a', 'ad', 'vd', 'vx', 'v') and p[-1].token <> '时'),
    scored as (select *, list_sum(list_transform(p, lambda x: x.w)) * {_CASES('n', lists.LENGTH_WEIGHTS, lists.OTHER_LENGTH)} * {_CASES("(case when n = 1 then p[1].tag else p[1].tag || '|' || p[-1].tag end)", lists.TAG_WEIGHTS, 1.0)} + list_sum(list_transform(p, lambda x: x.topic)) / n * 0.5 score from cand)"""


def _candidates(s, d, **rules) -> DataFrame:
    return phrases.ngrams(phrases.tagged_words(docs(s, d), "latin_fine"), **rules)


def _scored(s, d, **rules) -> DataFrame:
    return phrases.ngrams(phrases.weighted_sentences(docs(s, d), *_weights(s, d), criterion="latin_fine"), **rules).withColumn("score", r6("score"))


_long = lambda df, *names: df.withColumns({n: F.col(n).cast("long") for n in names})
query("ngram_candidates", f"with {_PHRASES} select doc_id, sent, pos, n, phrase from cand")(lambda s, d: _long(_candidates(s, d), "sent", "pos", "n"))
query("phrase_scores", f"with {_PHRASES} select doc_id, sent, pos, n, phrase, {S.r6('score')} score from scored")(lambda s, d: _long(_scored(s, d), "sent", "pos", "n"))
query("phrase_specified_words", f"with {_PHRASES} select doc_id, sent, pos, n, phrase, {S.r6('score')} score from scored where list_has_any(list_transform(p, lambda x: x.token), ['onou', 'ha', 'ch'])")(
    lambda s, d: _long(_scored(s, d, specified=["onou", "ha", "ch"]), "sent", "pos", "n")
)
_FUNCTION = lambda x: S.among(x, lists.FUNCTION_TAGS)
query(
    "phrase_loose_candidates",
    f"""with {_PHRASES}, lg as (select doc_id, sent, pos, n, a[1:n] p, array_to_string(list_transform(a[1:n], lambda x: x.token), ' ') phrase from (select doc_id, sent, pos, a, unnest(range(1, least(3, len(a)) + 1)) n from pa))
    select doc_id, sent, pos, n, phrase from lg where length(phrase) between 1 and 25 and not {S.among('phrase', lists.ALL_STOP_WORDS)} and p[-1].token <> '时' and len(list_filter(p, lambda x: {_FUNCTION('x.tag')})) <= 1
    and len(list_filter(p, lambda x: {S.among('x.token', lists.ALL_STOP_WORDS)})) = 0 and not {_FUNCTION('p[1].tag')} and not {_FUNCTION('p[-1].tag')} and p[-1].tag not in ('v', 'd')""",
)(lambda s, d: _long(_candidates(s, d, strict=False, max_window=3), "sent", "pos", "n"))
_PENALTY = f"""{_PHRASES}, ph as materialized (select doc_id, row_number() over (partition by doc_id order by n desc, sent, pos) k, phrase, score, list_distinct(list_transform(p, lambda x: x.token)) own from scored),
    ow as materialized (select doc_id, k, unnest(own) token from ph), sh as (select y.doc_id, y.k, x.k other, count(*) c from ow x join ow y on x.doc_id = y.doc_id and x.token = y.token and x.k < y.k group by all),
    pe as (select doc_id, k, max(c) c from sh group by all), fs as (select doc_id, k, phrase, score * (1 - coalesce(c, 0) / len(own)) score from ph left join pe using (doc_id, k)),
    fr as (select doc_id, phrase, score, row_number() over (partition by doc_id order by round(score, 9) desc, k) rank from fs where score <> 0)"""
for _name, _k in {"phrase_mmr": None, "phrase_topk": 5}.items():
    query(_name, f"with {_PENALTY} select doc_id, phrase, {S.r6('score')} score, rank from fr" + (f" where rank <= {_k}" if _k else ""))(
        lambda s, d, k=_k: phrases.key_phrases(docs(s, d), *_weights(s, d), top_k=k, criterion="latin_fine").withColumn("score", r6("score"))
    )

# -- information -----------------------------------------------------------------------------

query("entropy", f"select {S.r6('-sum(p * ln(p))')} entropy from (select count(*) / sum(count(*)) over () p from events group by event_type)")(lambda s, d: information.entropy(table(s, d, "events"), "event_type").select(r6("entropy").alias("entropy")))
_JOINT = "j as (select x, y, n / sum(n) over () p, sum(n) over (partition by x) / sum(n) over () px, sum(n) over (partition by y) / sum(n) over () py from (select {x} x, {y} y, count(*) n from {t} group by all))"
for _name, (_t, _x, _y) in {"joint_entropy_labels": ("labels", "quality", "toxic"), "joint_entropy_documents": ("documents", "lang", "source"), "joint_entropy_orders": ("orders", "o_orderpriority", "o_orderstatus")}.items():
    query(
        _name,
        f"with {_JOINT.format(t=_t, x=_x, y=_y)}, h as (select -sum(p * ln(px)) h_x, -sum(p * ln(py)) h_y, -sum(p * ln(p)) h_xy, sum(p * ln(p / (px * py))) mi from j) select {', '.join(f'{S.r6(e)} {n}' for n, e in {'h_x': 'h_x', 'h_y': 'h_y', 'h_xy': 'h_xy', 'h_y_given_x': 'h_xy - h_x', 'mi': 'mi', 'nmi': 'mi / h_xy'}.items())} from h",
    )(lambda s, d, t=_t, x=_x, y=_y: information.joint_statistics(table(s, d, t), x, y).select(*[r6(c).alias(c) for c in ("h_x", "h_y", "h_xy", "h_y_given_x", "mi", "nmi")]))
query("bayes_lang_source", f"with {_JOINT.format(t='documents', x='lang', y='source')} select x, y, {', '.join(f'{S.r6(e)} {n}' for n, e in {'p': 'p', 'px': 'px', 'py': 'py', 'y_given_x': 'p / px', 'x_given_y': 'p / py'}.items())} from j")(
    lambda s, d: information.bayes(table(s, d, "documents"), "lang", "source").select("x", "y", *[r6(c).alias(c) for c in ("p", "px", "py", "y_given_x", "x_given_y")])
)
query("pmi_npmi", f"with {S.TF}, t as (select token, lang, tf from tf join documents using (doc_id)), j as (select token, lang, n / sum(n) over () p, sum(n) over (partition by token) / sum(n) over () px, sum(n) over (partition by lang) / sum(n) over () py from (select token, lang, sum(tf) n from t group by all)) select token x, lang y, {S.r6('ln(p / (px * py))')} pmi, {S.r6('ln(p / (px * py)) / -ln(p)')} npmi from j")(
    lambda s, d: information.pointwise(information.joint(terms.document_tokens(docs(s, d).select("doc_id", "text")).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id"), "token", "lang")).select("x", "y", r6("pmi").alias("pmi"), r6("npmi").alias("npmi"))
)


@query("odds_logit", f"select event_type, {S.r6('p / (1 - p)')} odds, {S.r6('ln(p / (1 - p))')} logit, {S.r6('-ln(p)')} information from (select event_type, count(*) / sum(count(*)) over () p from events group by 1)")
def _(s, d):
    p = F.col("p")
    return information.distribution(table(s, d, "events"), "event_type").select("event_type", r6(information.odds(p)).alias("odds"), r6(information.logit(p)).alias("logit"), r6(information.information(p)).alias("information"))


@query(
    "kl_js_divergence",
    f"""with e as (select event_type k, user_id % 2 g, count(*) n from events group by all), p as (select k, n / sum(n) over () p from e where g = 0), q as (select k, n / sum(n) over () q from e where g = 1),
    b as (select k, coalesce(p, 0) p, coalesce(q, 0) q from p full join q using (k)), m as (select *, (p + q) / 2 m from b)
    select {S.r6('sum(case when p > 0 then p * ln(p / q) else 0 end)')} kl, {S.r6('sum(case when p > 0 then -p * ln(q) else 0 end)')} cross_entropy, {S.r6('sum(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / 2')} js from m""",
)
def _(s, d):
    half = lambda k: information.distribution(table(s, d, "events").where(F.col("user_id") % 2 == k), "event_type")
    return information.divergences(information.smoothed_pair(half(0), half(1), "event_type")).select(*[r6(c).alias(c) for c in ("kl", "cross_entropy", "js")])


# -- topics ----------------------------------------------------------------------------------

query("topic_marginals", f"with {S.TOPIC} select topic, {S.r6('p')} p, cast(mass as bigint) mass from tm")(lambda s, d: _topic_tables(s, d)[3].select("topic", r6("p").alias("p"), F.col("mass").cast("long").alias("mass")))
query("word_marginals", f"with {S.TOPIC} select token, round(p, 9) + 0.0 p from wm")(lambda s, d: _topic_tables(s, d)[4].select("token", (F.round("p", 9) + 0.0).alias("p")))


@query("topic_given_word", f"with {S.TOPIC}, g as (select token, topic, tw.p * tm.p x from tw join tm using (topic)) select token, topic, round(x / sum(x) over (partition by token), 12) + 0.0 p from g")
def _(s, d):
    tw, _, _, tm, _ = _topic_tables(s, d)
    return topics.topics_of_words(tw, tm).withColumn("p", F.round("p", 12) + 0.0)


@query("etf", f"with {S.TOPIC} select topic, token, {S.r6('tw.p * mass')} etf from tw join tm using (topic)")
def _(s, d):
    tw, _, _, tm, _ = _topic_tables(s, d)
    return topics.estimated_frequency(tw, tm).withColumn("etf", r6("etf"))


def _ranked(cte: str, value: str, by: str = "topic") -> str:
    part = f"partition by {by} " if by else ""
    return f"select * from (select *, row_number() over ({part}order by round({value}, 12) desc, token) rank from {cte})"


_REL = f"{S.TOPIC}, rel as (select topic, token, 0.6 * ln(tw.p) + 0.4 * ln(tw.p / wm.p) relevance, tw.p / wm.p lift from tw join wm using (token))"


@query("relevance", f"with {_REL} select topic, rank, token, {S.r6('relevance')} relevance from ({_ranked('rel', 'relevance')}) where rank <= 30")
def _(s, d):
    tw, _, _, _, wm = _topic_tables(s, d)
    found = topics.top_words(topics.relevance(tw, wm).drop("lift"), 30, "relevance")
    return found.select("topic", F.col("rank").cast("long").alias("rank"), "token", r6("relevance").alias("relevance"))


query("distinctiveness", f"with {S.DISTINCT} select token, {S.r6('weight')} weight from dis")(lambda s, d: (lambda x: topics.distinctiveness(x[0], x[3]).withColumn("weight", r6("weight")))(_topic_tables(s, d)))
query("topic_prominence", f"with {S.DISTINCT} select token, {S.r6('weight')} weight from prom")(lambda s, d: _prominence(s, d).withColumn("weight", r6("weight")))


@query("saliency_top", f"with {S.DISTINCT}, sal as (select token, wm.p * weight saliency from wm join dis using (token)) select token, round(saliency, 9) + 0.0 saliency from sal order by round(saliency, 12) desc, token limit 50")
def _(s, d):
    tw, _, _, tm, wm = _topic_tables(s, d)
    best = topics.saliency(wm, topics.distinctiveness(tw, tm)).orderBy(F.desc(F.round("saliency", 12)), "token").limit(50)
    return best.select("token", (F.round("saliency", 9) + 0.0).alias("saliency"))


@query(
    "sparse_prominence",
    f"""with {S.TOPIC}, g as (select token, topic, p / sum(p) over (partition by token) p from tw), r as (select token, sum(p * (log2(p) - log2(0.01))) + (100 - count(*)) * 1e-5 * log2(1e-5 / 0.01) w from g group by 1)
    select token, {S.r6('(w - min(w) over ()) / (max(w) over () - min(w) over ())')} weight from r""",
)
def _(s, d):
    return topics.prominence(topics.topics_of_words(_topic_tables(s, d)[0])).withColumn("weight", r6("weight"))


_TOP = f"{S.TOPIC}, top as materialized (select topic, rank, token, p from ({_ranked('tw', 'p')}) where rank <= 10)"


def _top(s, d, tf: DataFrame | None = None) -> DataFrame:
    return topics.top_words(_topic_tables(s, d, tf)[0], 10)


def _co_documents(s, d) -> tuple[DataFrame, DataFrame]:
    tf = cut(_labelled(s, d))
    return metrics.co_documents(cut(_top(s, d, tf)), tf)


query("top_words", f"with {_TOP} select topic, rank, token, {S.r6('p')} p from top")(lambda s, d: _top(s, d).select("topic", F.col("rank").cast("long").alias("rank"), "token", r6("p").alias("p")))
query("topic_diversity", f"with {_TOP} select {S.r6('sum(case when n = 1 then 1 else 0 end) / sum(n)')} diversity from (select token, count(*) n from top group by 1)")(lambda s, d: metrics.diversity(_top(s, d)).select(r6("diversity").alias("diversity")))
_OVERLAP = " + ".join(f"len(list_intersect(x.ws[1:{k}], y.ws[1:{k}])) / len(list_distinct(x.ws[1:{k}] || y.ws[1:{k}]))" for k in range(1, 11))
query("rank_overlap", f"with {_TOP}, l as (select topic, list(token order by rank) ws from top group by 1) select x.topic topic_a, y.topic topic_b, {S.r6(f'({_OVERLAP}) / 10')} overlap, {S.r6(f'1 - ({_OVERLAP}) / 10')} inverted from l x join l y on x.topic < y.topic")(
    lambda s, d: metrics.topic_overlap(_top(s, d), 10).select("topic_a", "topic_b", r6("overlap").alias("overlap"), r6("inverted").alias("inverted"))
)
_PAIRS = f"""{_TOP}, dt as (select distinct doc_id, token from tf where token in (select token from top)), one as (select token, count(*) d from dt group by 1), two as (select x.token a, y.token b, count(*) n from dt x join dt y using (doc_id) where x.token < y.token group by all),
    pairs as (select x.topic, x.token a, y.token b, coalesce(two.n, 0) both_n, ox.d da, oy.d db from top x join top y on x.topic = y.topic and x.rank < y.rank left join two on two.a = least(x.token, y.token) and two.b = greatest(x.token, y.token) join one ox on ox.token = x.token join one oy on oy.token = y.token)"""
query("umass", f"with {_PAIRS} select topic, {S.r6('avg(ln((both_n + 1) / da))')} u_mass from pairs group by 1")(lambda s, d: metrics.u_mass(_co_documents(s, d)[0]).withColumn("u_mass", r6("u_mass")))


@query("coherence_uci_npmi", f"with {_PAIRS}, z as (select count(distinct doc_id) n from tf), q as (select topic, both_n / n + 1e-12 p, (da / n) * (db / n) i from pairs, z) select topic, {S.r6('avg(ln(p / i))')} c_uci, {S.r6('avg(case when p < 1 then ln(p / i) / -ln(p) else 1 end)')} c_npmi from q group by 1")
def _(s, d):
    return metrics.c_uci(*_co_documents(s, d)).select("topic", r6("c_uci").alias("c_uci"), r6("c_npmi").alias("c_npmi"))


@query(
    "topic_distances",
    f"""with {S.TOPIC}, tp as (select distinct topic from tw), pr as (select x.topic topic_a, y.topic topic_b from tp x join tp y on x.topic <> y.topic),
    u as (select topic_a, topic_b, token, p, null q from pr join tw on topic = topic_a union all select topic_a, topic_b, token, null, p from pr join tw on topic = topic_b),
    m as (select topic_a, topic_b, token, coalesce(max(p), 1e-9) p, max(p) is not null has, coalesce(max(q), 1e-9) q from u group by all)
    select topic_a, topic_b, {S.r6('sum(case when has then p * ln(p / q) else 0 end)')} kl, {S.r6('avg(abs(ln(p / (1 - p)) - ln(q / (1 - q))))')} log_odds from m group by all""",
)
def _(s, d):
    return metrics.topic_distances(_topic_tables(s, d)[0]).select("topic_a", "topic_b", r6("kl").alias("kl"), r6("log_odds").alias("log_odds"))


@query(
    "topic_significance",
    f"""with {S.TOPIC}, v as (select count(*) v from wm), nd as (select count(*) d from documents), md as (select topic, count(*) m from lab group by 1)
    select topic, {S.r6('sum(tw.p * ln(tw.p * v))')} uniform, {S.r6('sum(tw.p * ln(tw.p / wm.p))')} vacuous, {S.r6('max(ln(d / m))')} background from tw join wm using (token) join md using (topic), v, nd group by 1""",
)
def _(s, d):
    tw, dt, _, _, wm = _topic_tables(s, d)
    return metrics.significance(tw, wm, dt).select("topic", *[r6(c).alias(c) for c in ("uniform", "vacuous", "background")])


query(
    "centroid_similarity",
    f"""with l as (select label, unnest(range(64)) k, unnest(embedding) v from embeddings), m as (select label, k, avg(cast(v as double)) v from l group by all), n as (select label, sqrt(sum(v * v)) n from m group by 1)
    select x.label a, y.label b, {S.r6('sum(x.v * y.v) / max(nx.n * ny.n)')} cosine from m x join m y on x.k = y.k and x.label < y.label join n nx on nx.label = x.label join n ny on ny.label = y.label group by all""",
)(lambda s, d: metrics.centroid_similarity(table(s, d, "embeddings"), "label", "embedding").withColumn("cosine", r6("cosine")))


@query(
    "coherence_cv",
    f"""with {_PAIRS}, z as (select count(distinct doc_id) n from tf), q as (select topic, a, b, both_n / n + 1e-12 p, (da / n) * (db / n) i from pairs, z), o as (select topic, a, b, case when p < 1 then ln(p / i) / -ln(p) else 1.0 end v from q),
    t as materialized (select topic, a, b, v from o union all select topic, b, a, v from o union all select topic, token, token, 1.0 from top), s as (select topic, b, sum(v) s from t group by all),
    c as (select topic, a, sum(v * s) / sqrt(sum(v * v) * sum(s * s)) c from t join s using (topic, b) group by all) select topic, {S.r6('avg(c)')} c_v from c group by 1""",
)
def _(s, d):
    return metrics.c_v(*_co_documents(s, d)).select("topic", r6("c_v").alias("c_v"))


def _word_vectors(s, d) -> DataFrame:
    return metrics.word_vectors(docs(s, d).select(K.tokenize(F.col("text")).alias("tokens")))


query("coherence_w2v")(lambda s, d: metrics.c_w2v(_top(s, d), _word_vectors(s, d)))
query("embedding_overlap")(lambda s, d: metrics.embedding_overlap(_top(s, d), _word_vectors(s, d)))


@query("matrix_multiply", f"with {S.TF}, l as (select lang, doc_id from documents) select lang \"row\", token col, cast(sum(tf) as double) v from tf join l using (doc_id) group by all")
def _(s, d):
    """Languages by documents times documents by tokens."""
    a = table(s, d, "documents").select(F.col("lang").alias("row"), F.col("doc_id").alias("col"), F.lit(1.0).alias("v"))
    return matrix.multiply(a, _tf(s, d).select(F.col("doc_id").alias("row"), F.col("token").alias("col"), F.col("tf").cast("double").alias("v")))


def _mmr_sql() -> str:
    """Five rounds: in each the best item of a label by relevance less its largest cosine to those taken."""
    out = """with m as (select label, list(v order by k) m from (select label, k, avg(cast(v as double)) v from (select label, unnest(range(64)) k, unnest(embedding) v from embeddings) group by all) group by 1),
    i0 as materialized (select label, vec_id, cast(embedding as double[]) v, list_dot_product(cast(embedding as double[]), m) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * list_dot_product(m, m)) rel, cast(null as double) near from embeddings join m using (label)),
    s1 as materialized (select label, vec_id, v, rel / 2 score from i0 qualify row_number() over (partition by label order by round(score, 9) desc, vec_id) = 1)"""
    for k in range(2, 6):
        out += f""",
    i{k - 1} as materialized (select i.label, i.vec_id, i.v, i.rel, greatest(i.near, list_dot_product(i.v, t.v) / sqrt(list_dot_product(i.v, i.v) * list_dot_product(t.v, t.v))) near from i{k - 2} i join s{k - 1} t on i.label = t.label where i.vec_id <> t.vec_id),
    s{k} as materialized (select label, vec_id, v, (rel - near) / 2 score from i{k - 1} qualify row_number() over (partition by label order by round(score, 9) desc, vec_id) = 1)"""
    return out + " " + " union all ".join(f"select label key, vec_id item, {S.r6('score')} score, {k} rank from s{k}" for k in range(1, 6))


@query("mmr_selection", _mmr_sql())
def _(s, d):
    """Five vectors of each label: like the label's mean, unlike one another."""
    e = table(s, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    items = e.join(mean.select("label", F.transform("m", lambda x: x["v"]).alias("m")), "label").select("label", F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"), "m")
    items = items.withColumn("rel", dot(F.col("v"), F.col("m")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("m"), F.col("m"))))
    return retrieval.mmr(cut(items.select("label", "item", "rel", "v")), "label", "rel", "v").withColumn("score", r6("score"))


def _features(s, d) -> tuple[DataFrame, DataFrame]:
    tf = cut(_tf(s, d))
    vocab = cut(terms.vocabulary(*_df(s, d, tf)))
    return cut(topics.vectors(terms.bag_of_words(tf, vocab), vocab.count())), vocab


@query("lda_topics")
def _(s, d):
    features, vocab = _features(s, d)
    return topics.top_words(topics.TopicModel(10, seed=1).fit(features).topic_word(vocab), 20)


@query("lda_doc_topics")
def _(s, d):
    features, _ = _features(s, d)
    return topics.TopicModel(10, seed=1).fit_transform(features)


@query("lda_clusters")
def _(s, d):
    features, _ = _features(s, d)
    return topics.clusters(topics.TopicModel(10, seed=1).fit_transform(features))


@query("lda_perplexity")
def _(s, d):
    features, _ = _features(s, d)
    return s.createDataFrame([(10, topics.TopicModel(10, seed=1).fit(features).log_perplexity(features))], "num_topics int, log_perplexity double")


@query("topic_classification")
def _(s, d):
    """Precision, recall, F1 and accuracy of a random forest that tells the language from the topics of the document."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer

    features, _ = _features(s, d)
    found = topics.TopicModel(10, seed=1).fit(features).model.transform(features).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    found = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(found).transform(found)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = RandomForestClassifier(featuresCol="topicDistribution", seed=1, numTrees=20).fit(found.where(~held))
    scored = model.transform(found.where(held))
    names = ("weightedPrecision", "weightedRecall", "f1", "accuracy")
    return s.createDataFrame([tuple(MulticlassClassificationEvaluator(metricName=m).evaluate(scored) for m in names)], ", ".join(f"{m} double" for m in names))


# -- datasets --------------------------------------------------------------------------------

query("shuffle_hash", "select doc_id, lang, row_number() over (order by md5('666:' || doc_id), doc_id) - 1 place from documents")(
    lambda s, d: dataset.shuffled(table(s, d, "documents").select("doc_id", "lang"), "doc_id", name="place")
)
query("sample_prefix", "select doc_id, lang, source from documents order by doc_id limit 150")(lambda s, d: dataset.prefix(table(s, d, "documents").select("doc_id", "lang", "source"), ["doc_id"]))
query("row_index", "select doc_id, text, row_number() over (order by doc_id) - 1 row_index from documents")(lambda s, d: dataset.row_index(table(s, d, "documents").select("doc_id", "text"), ["doc_id"]))
query("union_sources", "select 0 source_idx, row_number() over (order by text, id) - 1 inner_idx, text, id from (select text, cast(doc_id as varchar) id from documents) union all select 1, row_number() over (order by text, id) - 1, text, id from (select text, cast(item_id as varchar) id from benchmark)")(
    lambda s, d: dataset.Chained([docs(s, d).select("text", F.col("doc_id").cast("string").alias("id")), table(s, d, "benchmark").select("text", F.col("item_id").cast("string").alias("id"))], ["text", "id"]).rows().select("source_idx", "inner_idx", "text", "id")
)
query("dataset_map", "select doc_id, lang, length(text) n, strlen(text) n_bytes from documents")(
    lambda s, d: dataset.map_dataset(docs(s, d).select("doc_id", "lang", "text"), lambda t: {"n": len(t), "n_bytes": len(t.encode())}, "n long, n_bytes long", input_columns="text", remove_columns="text")
)
query("dataset_map_batched", "select doc_id, length(text) n from documents")(
    lambda s, d: dataset.map_dataset(docs(s, d).select("doc_id", "text"), lambda t: {"n": [len(x) for x in t]}, "n long", input_columns=["text"], remove_columns=["text"], batched=True)
)
