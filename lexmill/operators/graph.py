"""PageRank and TextRank: many small graphs in one pass, and one large graph by joins.

With W[i, j] the weight between i and j, a score is s_i = (1 - d) t_i + d * sum_j
W[i, j] / sum_k W[k, j] * s_j. TextRank's t is 1 for all, PageRank's 1 / n; given node
weights are normalised to sum 1. A column without weight gives nothing in TextRank and
1 / n to all in PageRank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import batches
from lexmill.plans.storage import cut


def page_rank(
    n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, node_weights: np.ndarray | None = None, start: np.ndarray | None = None, text_rank: bool = False,
    damping: float = 0.85, max_iter: int = 200, min_diff: float = 0.001,
) -> np.ndarray:
    """Scores of n nodes from weights w at (i, j), until no score changes by min_diff."""
    if node_weights is not None:
        if node_weights.shape != (n,) or not np.isfinite(node_weights).all():
            raise ValueError("node weights must be n finite numbers")
        t = node_weights / node_weights.sum()
    else:
        t = np.ones(n) if text_rank else np.full(n, 1 / max(n, 1))
    if np.isnan(w).any() or len(i) != len(j) or len(j) != len(w):
        raise ValueError("edges must be arrays of one length without NaN")
    sums = np.bincount(j, w, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = w / sums[j]
    share[~np.isfinite(share)] = 0.0
    dangling = (sums == 0) if not text_rank else np.zeros(n, bool)
    s = t.copy() if start is None else start.astype(np.float64)
    for _ in range(max_iter):
        new = (1 - damping) * t + damping * (np.bincount(i, share * s[j], n) + s[dangling].sum() / max(n, 1))
        done = len(s) == 0 or np.abs(new - s).max() < min_diff
        s = new
        if done:
            break
    return s


def cooccurrence(tokens: list[str], window: int = 4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Vocabulary, and the symmetric pairs of different tokens within the window, each once."""
    vocab = sorted(set(tokens))
    number = {t: k for k, t in enumerate(vocab)}
    ids = np.fromiter((number[t] for t in tokens), np.int64, len(tokens))
    n = len(vocab)
    pairs = [np.concatenate([ids[:-d] * n + ids[d:], ids[d:] * n + ids[:-d]]) for d in range(1, min(window, len(ids) - 1) + 1)]
    keys = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    i, j = keys // max(n, 1), keys % max(n, 1)
    return vocab, i[i != j], j[i != j]


def keyword_scores(tokens: list[str], window: int = 4, damping: float = 0.85, max_iter: int = 200, min_diff: float = 0.001) -> list[tuple[str, float]]:
    """Tokens with their TextRank score, the best first; ties in the tokens' order. Starts from the sigmoid of the degrees."""
    vocab, i, j = cooccurrence(tokens, window)
    if not vocab:
        return []
    n = len(vocab)
    degree = np.bincount(i, minlength=n).astype(np.float64)
    s = page_rank(n, i, j, np.ones(len(i)), start=1 / (1 + np.exp(-degree)), text_rank=True, damping=damping, max_iter=max_iter, min_diff=min_diff)
    return sorted(zip(vocab, s.tolist(), strict=True), key=lambda x: (-round(x[1], 9), x[0]))


class SentenceGraphs:
    """BM25 weights between the sentences of each of many documents, without their square tables.

    W[i, j] = sum over i's words t of c_i(t) idf(t) f_j(t) (k + 1) / (f_j(t) + K_i), i != j,
    K_i = k (1 - b + b len_i / mean): the length is the query sentence's. Sums over j only
    need, for each word and each number of its occurrences, a sum over the sentences that
    have it so often; that is linear in the words. Sentences of all documents are numbered
    one after the other; each document's words are its own, by their first appearance, so
    that its sums do not depend on its neighbours.
    """

    def __init__(self, per_doc: np.ndarray, per_sent: np.ndarray, code: np.ndarray, k1: float = 1.5, b: float = 0.75):
        self.per_doc, self.n, self.k1 = per_doc, len(per_sent), k1
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        sent = np.repeat(np.arange(self.n), per_sent)
        _, first, t = np.unique(self.doc[sent] * (int(code.max()) + 1 if len(code) else 1) + code, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        v = max(len(first), 1)
        keys, self.c = np.unique(sent * v + number[t], return_counts=True)
        self.i, self.t = keys // v, keys % v
        df = np.bincount(self.t, minlength=v)
        of_word = np.zeros(v, np.int64)
        of_word[self.t] = per_doc[self.doc[self.i]]
        self.idf = np.log(np.maximum(of_word - df, 0) + 0.5) - np.log(df + 0.5)
        sizes = per_sent.astype(np.float64)
        total = np.bincount(self.doc, sizes, len(per_doc))
        mean = np.where(total > 0, total / np.maximum(per_doc, 1), 1.0)
        self.big_k = k1 * (1 - b + b * sizes / mean[self.doc])
        # (word, occurrences) classes, and for each entry (sentence, word) the classes of its word
        most = int(self.c.max()) + 1 if len(self.c) else 1
        classes, self.of = np.unique(self.t * most + self.c, return_inverse=True)
        self.m = len(classes)
        class_c, class_t = classes % most, classes // most
        first = np.searchsorted(class_t, self.t)
        many = np.searchsorted(class_t, self.t, side="right") - first
        entry = np.repeat(np.arange(len(self.t)), many)
        self.cls = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        self.value = self._weight(entry, class_c[self.cls])
        self.own = self._weight(np.arange(len(self.t)), self.c)
        self.by = self.i[entry]

    def _weight(self, entry: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.c[entry] * self.idf[self.t[entry]] * f * (self.k1 + 1) / (f + self.big_k[self.i[entry]])

    def times(self, x: np.ndarray) -> np.ndarray:
        """W x"""
        return _times(x, self.n, self.m, self.i, self.of, self.own, self.by, self.cls, self.value)

    def column_sums(self) -> np.ndarray:
        by_class = np.bincount(self.cls, self.value, self.m)
        return np.bincount(self.i, by_class[self.of] - self.own, self.n)

    def rank(self, damping: float = 0.85, max_iter: int = 200, min_diff: float = 0.001, signed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and each document's sentence numbers by falling score; of equal scores the later sentence first.

        A document stops when no score of its own changes by min_diff, with signed when none
        rises so. Those that have stopped are left out once they are half of the rest.
        """
        sums, scores = self.column_sums(), np.ones(self.n)
        at, per = np.arange(self.n), self.per_doc[self.per_doc > 0]  # sentences still worked on, and their documents' numbers of them
        inverse = np.divide(1.0, sums, out=np.zeros(self.n), where=sums != 0)
        s, m, (i, of, own), (by, cls, value) = scores.copy(), self.m, (self.i, self.of, self.own), (self.by, self.cls, self.value)
        busy = np.ones(len(per), bool)
        for _ in range(max_iter):
            if not busy.any():
                break
            new = (1 - damping) + damping * _times(s * inverse, len(s), m, i, of, own, by, cls, value)
            change = new - s if signed else np.abs(new - s)
            s = np.where(np.repeat(busy, per), new, s)
            busy &= ~(np.maximum.reduceat(change, np.cumsum(per) - per) < min_diff)
            if 2 * busy.sum() <= len(busy):
                scores[at] = s
                kept = np.repeat(busy, per)
                place, in_use = np.cumsum(kept) - 1, np.zeros(m, bool)
                mine, entries = kept[i], kept[by]
                in_use[of[mine]] = True
                number = np.cumsum(in_use) - 1
                i, of, own = place[i[mine]], number[of[mine]], own[mine]
                by, cls, value = place[by[entries]], number[cls[entries]], value[entries]
                at, s, inverse, m, per, busy = at[kept], s[kept], inverse[kept], int(in_use.sum()), per[busy], busy[busy]
        scores[at] = s
        order = np.lexsort((-np.arange(self.n), -scores, self.doc))
        return scores, order - np.repeat(np.cumsum(self.per_doc) - self.per_doc, self.per_doc)


def _times(x: np.ndarray, n: int, m: int, i: np.ndarray, of: np.ndarray, own: np.ndarray, by: np.ndarray, cls: np.ndarray, value: np.ndarray) -> np.ndarray:
    sums = np.bincount(of, x[i], m)
    return np.bincount(by, value * sums[cls], n) - np.bincount(i, own * x[i], n)


class SentenceGraph(SentenceGraphs):
    """The graph of one document's sentences."""

    def __init__(self, sents: list[list[str]], k1: float = 1.5, b: float = 0.75):
        number: dict[str, int] = {}
        code = np.array([number.setdefault(t, len(number)) for s in sents for t in s], np.int64)
        super().__init__(np.array([len(sents)]), np.array([len(s) for s in sents], np.int64), code, k1, b)

    def rank(self, damping: float = 0.85, max_iter: int = 200, min_diff: float = 0.001, signed: bool = False) -> tuple[np.ndarray, list[int]]:
        s, order = super().rank(damping, max_iter, min_diff, signed)
        return s, order.tolist()


def map_rows(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable], keep: list[str] | None = None, rows: int = 32) -> DataFrame:
    """Each row's kept columns and the fields that make()'s function gives for the column's value, in small Arrow batches."""
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(column).alias("__v"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types, f = [to_arrow_type(x.dataType) for x in fields], make()
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                found = [f(v) for v in part.column("__v").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([r[k] for r in found], t) for k, t in enumerate(types)]], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def edges_of(df: DataFrame, tokens: Column, window: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, a, b): pairs of different tokens within the window, a < b, each once for a key.

    A row's pairs are made and told apart in one pass; only where rows share a key they meet by it.
    """
    fields = [T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]
    found = batches.map_tokens(df, [key], tokens, fields, batches.pairs(window))
    return found if batches.one_row_each(df, key) else found.distinct()


def both_ways(edges: DataFrame, key: str) -> DataFrame:
    return edges.select(key, F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(key, F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, degree, start) of undirected edges; start is the degree's sigmoid."""
    return _started(both_ways(edges, key).groupBy(key, F.col("src").alias("token")).agg(F.count("*").alias("degree")))


def degrees_of(df: DataFrame, tokens: Column, window: int = 4, key: str = "doc_id") -> DataFrame:
    """`degrees` of `edges_of`: where each row has a key of its own, a row's degrees are counted in the pass that makes its pairs, without a table of edges."""
    if not batches.one_row_each(df, key):
        return degrees(edges_of(df, tokens, window, key), key)
    fields = [T.StructField("token", T.StringType()), T.StructField("degree", T.LongType())]
    return _started(batches.map_tokens(df, [key], tokens, fields, batches.neighbours(window)))


def _started(d: DataFrame) -> DataFrame:
    return d.withColumn("start", 1 / (1 + F.exp(-F.col("degree").cast("double"))))


def page_rank_table(edges: DataFrame, rounds: int = 10, damping: float = 0.85, weights: DataFrame | None = None) -> DataFrame:
    """(node, score) of one large directed graph (src, dst, w) after a fixed number of rounds.

    Nodes without a way out spread over all. weights (node, weight) replaces the even
    teleport. Each round is one join and one sum over the edges. A round needs the scores
    twice, so they are cut off after each: else plans would double every round.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("__out")), "node", "left").select("node", F.col("__out").isNull().alias("dangling"))
    if weights is None:
        total = nodes.agg(F.count("*").alias("n"))
        nodes = nodes.crossJoin(F.broadcast(total)).select("node", "dangling", (F.lit(1.0) / F.col("n")).alias("t"), "n")
    else:
        given = nodes.join(weights, "node", "left").select("node", "dangling", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        total = given.agg(F.count("*").alias("n"), F.sum("weight").alias("sum"))
        nodes = given.crossJoin(F.broadcast(total)).select("node", "dangling", (F.col("weight") / F.col("sum")).alias("t"), "n")
    nodes = cut(nodes)
    s = nodes.select("node", F.col("t").alias("score"))
    for _ in range(rounds):
        got = share.join(s, share.src == s.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        lost = nodes.where("dangling").join(s, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        s = cut(nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) * F.col("t") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("score")))
    return s
