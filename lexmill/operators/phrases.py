"""Key phrases: candidate n-grams of tagged tokens, scores by weight tables, and a penalty for overlap with longer ones.

A document stays one row. Its distinct words are looked up once in the weight tables; then
one pass over each batch of documents makes and scores the n-grams (`ngrams`) and compares
them (`key_phrases`), so that no n-gram is shuffled. `candidates` and `phrase_scores` give
the same n-grams with their tokens, from slices of the row's own arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import lists
from lexmill.functions.split import sentences
from lexmill.functions.tokens import normal_tag, tag, tokenize
from lexmill.operators import batches
from lexmill.operators.graph import map_rows
from lexmill.operators.weights import with_words


def tagged_sentences(docs: DataFrame, criterion: str = "fine", text: str = "text") -> DataFrame:
    """(doc_id, sents): the tokens of each sentence."""
    return docs.select("doc_id", F.transform(sentences(F.coalesce(F.col(text), F.lit("")), criterion), lambda s: tokenize(s)).alias("sents"))


def weighted_sentences(docs: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, known_tags: Sequence[str] | None = None, specified: Sequence[str] = (), bonus: float = 1.0, criterion: str = "fine", tagger=tag, text: str = "text") -> DataFrame:
    """(doc_id, sents, words): words has (token, idf, topic, tag, mute, bonus) of each distinct token.

    A token weighs its share of the document's tokens times idf (nothing if mute: a stop
    word or a tag that is not known), plus the bonus of a specified word. Unknown words
    weigh the upper median of the idf table and half the mean of the other one.
    """
    own = normal_tag(tagger(F.col("token")))
    mute = F.col("token").isin(*lists.ALL_STOP_WORDS)
    if known_tags is not None:
        mute |= ~own.isin(*known_tags)
    more = F.when(F.col("token").isin(*specified), float(bonus)).otherwise(0.0) if specified else F.lit(0.0)
    return with_words(tagged_sentences(docs, criterion, text), F.flatten("sents"), idf, prominence, unknown_idf, unknown_prominence, tag=own, mute=mute, bonus=more)


def weighted_tokens(found: DataFrame) -> DataFrame:
    """(doc_id, sent, a): each sentence's tokens as (token, tag, w, topic), of (doc_id, sents, words)."""

    def make():
        def f(v: dict):
            tokens = weigh(v["sents"], v["words"])
            return ([[tokens[t] for t in s] for s in v["sents"] or []],)

        return f

    token = T.StructType([T.StructField("token", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("w", T.DoubleType()), T.StructField("topic", T.DoubleType())])
    rows = map_rows(found.withColumn("__in", F.struct("sents", "words")), "__in", [T.StructField("a", T.ArrayType(T.ArrayType(token)))], make, ["doc_id"])
    return rows.select("doc_id", F.posexplode("a").alias("sent", "a"))


def weigh(sents: list[list[str]] | None, words: list[dict] | None) -> dict[str, dict]:
    """Token, tag, w and topic of each of a document's tokens."""
    tf = Counter(chain.from_iterable(sents or []))
    total = max(1, tf.total())
    return {x["token"]: {"token": x["token"], "tag": x["tag"], "w": (0.0 if x["mute"] else tf[x["token"]] / total * x["idf"]) + x["bonus"], "topic": x["topic"]} for x in words or []}


def candidates(weighted: DataFrame, max_window: int = 12, strict: bool = True, allow_place: bool = True, allow_person: bool = True, max_chars: int = 25, last_not: Sequence[str] = ("时",), remove_words: Sequence[str] = (), specified: Sequence[str] = (), remove_phrases: Sequence[str] = (), separator: str = " ") -> DataFrame:
    """(doc_id, sent, pos, n, phrase, p): the n-grams of 1 to max_window tokens that the rules allow; p are their tokens.

    weighted is (doc_id, sent, a); n-grams are slices of a. separator joins the tokens of a
    phrase: a space where the script has spaces.
    """
    tags = [t for t in lists.STRICT_TAGS if (allow_place or t != "ns") and (allow_person or t != "nr")]
    seen = weighted.select("doc_id", "sent", F.posexplode(F.transform("a", lambda x, i: F.slice("a", i + 1, max_window))).alias("pos", "a"))
    if strict:
        # only the allowed tokens from here on matter: the slice is cut at the first other one
        bad = F.array_position(F.transform("a", lambda x: F.when(x["tag"].isin(*tags), 0).otherwise(1)), 1)
        seen = seen.withColumn("a", F.when(bad > 0, F.slice("a", F.lit(1), (bad - 1).cast("int"))).otherwise(F.col("a"))).where(F.size("a") > 0)
    grams = seen.select("doc_id", "sent", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("a")), lambda n: F.slice("a", F.lit(1), n))).alias("p"))
    grams = grams.withColumn("n", F.size("p")).withColumn("phrase", F.array_join(F.transform("p", lambda x: x["token"]), separator))
    first, last, stop = F.element_at("p", 1)["tag"], F.element_at("p", -1)["tag"], list(lists.ALL_STOP_WORDS)
    rules = F.length("phrase").between(1, max_chars) & ~F.col("phrase").isin(*stop) & ~F.element_at("p", -1)["token"].isin(*last_not)
    if strict:
        rules &= ~first.isin("v", "vd", "vx") & ~last.isin("a", "ad", "vd", "vx", "v")
    else:
        function = lambda c: c.isin(*lists.FUNCTION_TAGS)
        rules &= (F.size(F.filter("p", lambda x: function(x["tag"]))) <= 1) & ~F.exists("p", lambda x: x["token"].isin(*stop))
        rules &= ~function(first) & ~function(last) & ~last.isin("v", "d")
        if not allow_place:
            rules &= ~F.exists("p", lambda x: x["tag"] == "ns")
        if not allow_person:
            rules &= ~F.exists("p", lambda x: x["tag"] == "nr")
    if remove_words:
        rules &= ~F.exists("p", lambda x: x["token"].isin(*remove_words))
    if specified:
        rules &= F.exists("p", lambda x: x["token"].isin(*specified))
    if remove_phrases:
        rules &= ~F.col("phrase").isin(*remove_phrases)
    return grams.where(rules).select("doc_id", "sent", "pos", "n", "phrase", "p")


def phrase_scores(found: DataFrame, theta: float = 0.5) -> DataFrame:
    """The candidates with score: sum of weights * length weight * tag weight + mean prominence * theta."""
    by_length = F.create_map(*[F.lit(x) for kv in lists.LENGTH_WEIGHTS.items() for x in kv])
    by_tags = F.create_map(*[F.lit(x) for kv in lists.TAG_WEIGHTS.items() for x in kv])
    tags = F.when(F.col("n") == 1, F.element_at("p", 1)["tag"]).otherwise(F.concat_ws("|", F.element_at("p", 1)["tag"], F.element_at("p", -1)["tag"]))
    total = lambda name: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[name])
    score = total("w") * F.coalesce(F.try_element_at(by_length, F.col("n")), F.lit(lists.OTHER_LENGTH)) * F.coalesce(F.try_element_at(by_tags, tags), F.lit(1.0)) + total("topic") / F.col("n") * theta
    return found.withColumn("score", score)


class Rules:
    """What `candidates` allows, for `Grams`."""

    def __init__(self, max_window: int = 12, strict: bool = True, allow_place: bool = True, allow_person: bool = True, max_chars: int = 25, last_not: Sequence[str] = ("时",), remove_words: Sequence[str] = (), specified: Sequence[str] = (), remove_phrases: Sequence[str] = (), separator: str = " "):
        self.max_window, self.strict, self.max_chars, self.separator = max_window, strict, max_chars, separator
        self.tags = {t for t in lists.STRICT_TAGS if (allow_place or t != "ns") and (allow_person or t != "nr")}
        self.barred = {t for t, allowed in (("ns", allow_place), ("nr", allow_person)) if not allowed}
        self.stop, self.last_not, self.remove_words = frozenset(lists.ALL_STOP_WORDS), frozenset(last_not), frozenset(remove_words)
        self.specified, self.remove_phrases = frozenset(specified), frozenset(remove_phrases)
        self.function = frozenset(lists.FUNCTION_TAGS)

    def edges(self, first: str, last: str) -> bool:
        if self.strict:
            return first not in ("v", "vd", "vx") and last not in ("a", "ad", "vd", "vx", "v")
        return first not in self.function and last not in self.function and last not in ("v", "d")


#: Phrases of so many different tokens at most are compared by their subsets.
FEW = 5


def without_overlap(found: Sequence[tuple[Sequence[str], str, float]], top_k: int | None = 5) -> list[tuple[str, float]]:
    """(phrase, score), the best first, of (tokens, phrase, score) in order: the score times 1 less the largest share of a phrase's tokens that a longer one, or an earlier one of its length, has.

    A phrase within a kept one adds nothing for the later ones, so only kept ones count. A
    short phrase looks up its subsets, the largest first, among those of the kept ones: its
    work does not grow with the number of phrases that share a word.
    """
    subsets: set[tuple[str, ...]] = set()
    holders: dict[str, list[int]] = {}
    kept, out = 0, []
    for k, (tokens, phrase, score) in enumerate(sorted(found, key=lambda x: -len(x[0]))):
        own = sorted(set(tokens))
        if len(own) <= FEW:
            most = next((m for m in range(len(own), 0, -1) if any(c in subsets for c in combinations(own, m))), 0)
        else:
            most = max(Counter(chain.from_iterable(holders.get(t, ()) for t in own)).values(), default=0)
        if most < len(own):
            out.append((phrase, score * (1 - most / len(own)), k))
            for m in range(1, min(FEW, len(own)) + 1):
                subsets.update(combinations(own, m))
            for t in own:
                holders.setdefault(t, []).append(kept)
            kept += 1
    out = sorted((x for x in out if x[1] != 0), key=lambda x: (-round(x[1], 9), x[2]))[:top_k]
    return [(phrase, score) for phrase, score, _ in out]


class Grams:
    """The n-grams that `Rules` allow, in pieces of many documents: arrays by the place of their first token.

    tokens: `row`, `sent` (number within the row), `pos`, `code` of each place, `words` the
    distinct tokens; tags: a tag for each distinct token; w and topic, if given, by place and
    by token. An n-gram ends where no longer one can be allowed, so longer ones are tried only
    at the places where shorter ones were.
    """

    def __init__(self, rules: Rules, row: np.ndarray, end: np.ndarray, code: np.ndarray, words: pa.Array, tags: pa.Array, w: np.ndarray | None = None, topic: np.ndarray | None = None, theta: float = 0.5):
        named = tags.dictionary_encode()
        names, of = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
        within = lambda items: pc.is_in(words, value_set=pa.array(sorted(items), pa.string())).to_numpy(zero_copy_only=False)
        tagged = lambda f: np.array([f(t) for t in names], bool)[of] if len(of) else np.zeros(0, bool)
        stops = ~tagged(rules.tags.__contains__) if rules.strict else within(rules.stop) | tagged(rules.barred.__contains__)
        stops |= within(rules.remove_words)
        function = tagged(lambda t: not rules.strict and t in rules.function)
        first, last = tagged(lambda t: rules.edges(t, "")), tagged(lambda t: rules.edges("", t)) & ~within(rules.last_not)
        special = within(rules.specified) if rules.specified else np.ones(len(words), bool)
        barred = pa.array(sorted(rules.stop | rules.remove_phrases), pa.string())
        size, apart = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), len(rules.separator)
        pair = np.array([[lists.TAG_WEIGHTS.get(f"{a}|{b}", 1.0) for b in names] for a in names]) if names else np.ones((1, 1))
        single = np.array([lists.TAG_WEIGHTS.get(a, 1.0) for a in names])
        at = np.arange(len(code))
        chars, functions, any_special = np.full(len(code), -apart), np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        sums, topics = np.zeros(len(code)), np.zeros(len(code))
        found = []
        for n in range(1, rules.max_window + 1):
            fits = at + n - 1 < end[at]
            at, chars, functions, any_special, sums, topics = (x[fits] for x in (at, chars, functions, any_special, sums, topics))
            c = code[at + n - 1]
            chars, functions, any_special = chars + size[c] + apart, functions + function[c], any_special | special[c]
            if w is not None:
                sums, topics = sums + w[at + n - 1], topics + topic[c]
            goes = ~stops[c] & (chars <= rules.max_chars) & (functions <= 1)
            at, c, chars, functions, any_special, sums, topics = (x[goes] for x in (at, c, chars, functions, any_special, sums, topics))
            if not len(at):
                break
            head = code[at]
            keep = np.flatnonzero(first[head] & last[c] & any_special & (chars >= 1))
            parts = [words.take(pa.array(code[at[keep] + i])) for i in range(n)]
            phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, rules.separator)
            free = ~pc.is_in(phrase, value_set=barred).to_numpy(zero_copy_only=False)
            keep, phrase = keep[free], phrase.filter(pa.array(free))
            score = np.zeros(0)
            if w is not None:
                by_tags = single[of[head[keep]]] if n == 1 else pair[of[head[keep]], of[c[keep]]]
                score = sums[keep] * lists.LENGTH_WEIGHTS.get(n, lists.OTHER_LENGTH) * by_tags + topics[keep] / n * theta
            found.append((at[keep], np.full(len(keep), n), phrase, score))
        self.row, self.code = row, code
        self.at, self.n, self.score = (np.concatenate([np.zeros(0, kind), *[x[k] for x in found]]) for k, kind in ((0, np.int64), (1, np.int64), (3, np.float64)))
        self.phrase = pa.concat_arrays([pa.array([], pa.string()), *[x[2] for x in found]])

    def best(self, top_k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its best phrases in order, as numbers of n-grams, their scores by `without_overlap`, and their ranks."""
        row = self.row[self.at]
        order = np.lexsort((self.at, -self.n, row))
        row, at, n = row[order], self.at[order], self.n[order]
        # a row's distinct tokens as numbers that no other row has; each n-gram's own ones in order, the rest -1
        ids = np.unique(self.row * (int(self.code.max(initial=0)) + 1) + self.code, return_inverse=True)[1]
        total, widest = int(ids.max(initial=0)) + 1, int(n.max(initial=1))
        own = np.full((len(at), widest), -1, np.int64)
        for k in range(widest):
            own[n > k, k] = ids[at[n > k] + k]
        own.sort(axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
        own = -np.sort(-own, axis=1)
        many = (own >= 0).sum(axis=1)
        most = np.zeros(len(at), np.int64)
        subsets = {k: (np.flatnonzero(many == k), [()], np.zeros((int((many == k).sum()), 1), np.int64)) for k in range(1, min(FEW, widest) + 1)}
        for m in range(1, min(FEW, widest) + 1):
            keys, places, shapes = [], [], []
            for k in [k for k in subsets if k >= m]:
                at_k, before, known = subsets[k]
                chosen = list(combinations(range(k), m))
                rows = known[:, [before.index(c[:-1]) for c in chosen]] * total + own[at_k][:, [c[-1] for c in chosen]]
                subsets[k] = (at_k, chosen, rows)
                keys.append(rows.ravel())
                places.append(np.repeat(at_k, len(chosen)))
                shapes.append((k, rows.shape))
            if not keys:
                break
            place = np.concatenate(places)
            number = np.unique(np.concatenate(keys), return_inverse=True)[1]
            earliest = np.full(int(number.max(initial=-1)) + 1, len(at), np.int64)
            np.minimum.at(earliest, number, place)
            most[place[earliest[number] < place]] = m
            a = 0
            for k, shape in shapes:
                subsets[k] = (*subsets[k][:2], number[a : a + shape[0] * shape[1]].reshape(shape))
                a += shape[0] * shape[1]
        score = self.score[order] * (1 - most / np.maximum(many, 1))
        keep = (most < many) & (score != 0)
        wide = np.unique(row[many > FEW])
        if len(wide):  # rows with a phrase of many different tokens are compared one by one
            keep &= ~np.isin(row, wide)
        put, scores, ranks = [], [], []
        chosen = np.flatnonzero(keep)
        chosen = chosen[np.lexsort((chosen, -np.round(score[chosen], 9), row[chosen]))]
        place = np.arange(len(chosen)) - np.searchsorted(row[chosen], row[chosen])
        head = place < (len(chosen) if top_k is None else top_k)
        put, scores, ranks = [order[chosen[head]]], [score[chosen[head]]], [place[head] + 1]
        for r in wide.tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            best = without_overlap([(ids[at[i] : at[i] + n[i]].tolist(), i, float(self.score[order[i]])) for i in range(a, b)], top_k)
            put.append(order[np.array([i for i, _ in best], np.int64)])
            scores.append(np.array([x for _, x in best], np.float64))
            ranks.append(np.arange(len(best)) + 1)
        return np.concatenate(put), np.concatenate(scores), np.concatenate(ranks)


def _pass(found: DataFrame, allowed: Rules, theta: float, fields: list[T.StructField], result: Callable) -> DataFrame:
    """(doc_id, the fields): result gives, of the n-grams of (doc_id, sents, words), the rows' numbers and the fields' arrays; words have at least (token, tag)."""
    source = found.select("doc_id", "sents", "words")
    names = ["doc_id", *[f.name for f in fields]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            per_row, per_sent = batches.lengths(batch.column(1)), batches.lengths(batches.flat(batch.column(1)))
            for part in batches.pieces(batch, batches.inner_sums(per_row, per_sent)):
                at, columns = result(*_numbered(part, allowed, theta))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=names)

    return source.mapInArrow(run, T.StructType([source.schema.fields[0], *fields]))


def _numbered(part: pa.RecordBatch, allowed: Rules, theta: float) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The n-grams of (doc_id, sents, words), and each place's sentence and position in it."""
    sents, listed = batches.flat(part.column(1)), batches.flat(part.column(2))
    tokens, word = batches.flat(sents), lambda name: pc.struct_field(listed, name)
    per_row, per_sent = batches.lengths(part.column(1)), batches.lengths(sents)
    sizes = batches.inner_sums(per_row, per_sent)
    code, words = batches.numbered(pa.concat_arrays([tokens, word("token")]))
    v = len(words)
    code, known = code[: len(tokens)], code[len(tokens) :]
    one = np.zeros(v, np.int64)
    one[known] = np.arange(len(known))  # a word is the same in all rows
    of = lambda name: word(name).to_numpy(zero_copy_only=False)[one]
    row = np.repeat(np.arange(part.num_rows), sizes)
    end = np.repeat(np.cumsum(per_sent), per_sent)
    sent = np.repeat(np.arange(len(per_sent)) - np.repeat(np.cumsum(per_row) - per_row, per_row), per_sent)
    w = topic = None
    if v and "idf" in [f.name for f in listed.type]:
        _, which, tf = np.unique(row * v + code, return_inverse=True, return_counts=True)
        w = np.where(of("mute")[code], 0.0, tf[which] / np.maximum(sizes, 1)[row] * of("idf")[code]) + of("bonus")[code]
        topic = of("topic")
    tags = word("tag").take(pa.array(one))
    return Grams(allowed, row, end, code, words, tags, w, topic, theta), sent, np.arange(len(code)) - end + np.repeat(per_sent, per_sent)


def tagged_words(docs: DataFrame, criterion: str = "fine", tagger=tag, text: str = "text") -> DataFrame:
    """(doc_id, sents, words): words has (token, tag) of each distinct token; for n-grams without scores."""
    words = F.transform(F.array_distinct(F.flatten("sents")), lambda t: F.struct(t.alias("token"), normal_tag(tagger(t)).alias("tag")))
    return tagged_sentences(docs, criterion, text).select("doc_id", "sents", words.alias("words"))


def ngrams(found: DataFrame, theta: float = 0.5, **rules) -> DataFrame:
    """(doc_id, sent, pos, n, phrase), and score if the words have weights: `candidates` and `phrase_scores` of (doc_id, sents, words) in a pass over each batch of documents."""
    weighed = "idf" in found.schema["words"].dataType.elementType.names
    kinds = {"sent": T.IntegerType(), "pos": T.IntegerType(), "n": T.IntegerType(), "phrase": T.StringType()} | ({"score": T.DoubleType()} if weighed else {})

    def result(grams: Grams, sent: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        numbers = [pa.array(x.astype(np.int32)) for x in (sent[grams.at], pos[grams.at], grams.n)]
        return grams.row[grams.at], [*numbers, grams.phrase, *([pa.array(grams.score)] if weighed else [])]

    return _pass(found, Rules(**rules), theta, [T.StructField(k, t) for k, t in kinds.items()], result)


def key_phrases(docs: DataFrame, idf: DataFrame, prominence: DataFrame, unknown_idf: float | None = None, unknown_prominence: float | None = None, top_k: int | None = 5, theta: float = 0.5, criterion: str = "fine", specified: Sequence[str] = (), known_tags: Sequence[str] | None = None, tagger=tag, text: str = "text", **rules) -> DataFrame:
    """(doc_id, phrase, score, rank)"""
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative; None gives all")
    found = weighted_sentences(docs, idf, prominence, unknown_idf, unknown_prominence, known_tags, specified, criterion=criterion, tagger=tagger, text=text)

    def result(grams: Grams, *_) -> tuple[np.ndarray, list[pa.Array]]:
        best, score, rank = grams.best(top_k)
        return grams.row[grams.at[best]], [grams.phrase.take(pa.array(best)), pa.array(score), pa.array(rank)]

    fields = [T.StructField("phrase", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())]
    return _pass(found, Rules(specified=specified, **rules), theta, fields, result)
