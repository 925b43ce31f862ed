"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Each whole text gives the statistics `STATS` (shares of character kinds, repeated
   words and lines, word lengths) in one Arrow pass without a shuffle.
2. Boosted trees of small depth are grown on a bounded sample of labelled rows:
   `train_rows` of them at most, those whose ids have the smallest hashes, so that the
   sample does not depend on partitions. Only these texts are looked at before the scoring
   pass. Each path from a root is a rule: a conjunction of comparisons.
3. Lasso logistic regression weighs the rules (proximal gradient steps over a falling
   penalty); the sparsest model within a quarter of a standard error of the best loss on
   held-aside rows of the sample stays.
4. The rules with weights become one Spark column expression over the statistics, which
   scores all documents inside of code generation.

Labels of documents in the held-out fold are never read (see `fold`). Language, source,
id and labels are no statistics. Null texts count as empty. Without labels all scores are
one half; with labels of one class only there are no rules. Rows are answered each,
repeated ones too; those without an id are in no fold. Other columns are kept, but for
those named like a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_texts

STATS = [
    "log_words", "word_length", "symbols", "pipes", "upper", "bangs", "digits", "periods", "commas", "other_marks", "non_ascii", "distinct", "adjacent", "words_a_line",
    "dup_lines", "capitals", "stop_words", "longest_word",
]
_KINDS = {"symbols": b"#*$%&<>~^_=+@\\", "pipes": b"|", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "bangs": b"!?", "digits": b"0123456789", "periods": b".", "commas": b",", "other_marks": b"\"'();:/-[]{}`"}
#: Words of a run in which different words are counted, so that long texts compare with short ones.
WINDOW = 64
STOP_WORDS = frozenset(
    b"""a about all an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their they this to was we were which will with you
    au aux ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se son sur un une
    auf aus das dem den der des die ein eine er es ist mit nicht sich sie und von zu
    al como con del el era las lo los no o para por se su una y""".split()
)


def stats_of(text: bytes | None) -> list[float]:
    """A text's statistics in the order of STATS; shares are per thousand."""
    t = text or b""
    words = t.split()
    n, n_words = max(len(t), 1), len(words)
    seen = np.bincount(np.frombuffer(t, np.uint8), minlength=256) if t else np.zeros(256, np.int64)
    kinds = {k: 1000.0 * int(seen[list(v)].sum()) / n for k, v in _KINDS.items()}
    many = max(n_words, 1)
    lines = t.split(b"\n")
    low = t.lower().split()
    different = sum(len(set(words[i : i + WINDOW])) for i in range(0, n_words, WINDOW))
    return [
        math.log2(n_words + 1), sum(map(len, words)) / many, *(kinds[k] for k in _KINDS), 1000.0 * int(seen[128:].sum()) / n, 1000.0 * different / many,
        1000.0 * sum(map(eq, words, words[1:])) / many, n_words / len(lines), 1000.0 * (len(lines) - len(set(lines))) / len(lines), 1000.0 * sum(map(bytes.istitle, words)) / many,
        1000.0 * sum(map(STOP_WORDS.__contains__, low)) / many, float(min(max(map(len, words), default=0), 1000)),
    ]


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        def f(texts: list) -> list:
            rows = np.array([stats_of(t) for t in texts], np.float64).reshape(len(texts), len(STATS))
            return [pa.array(np.ascontiguousarray(c)) for c in rows.T]

        return f

    return map_texts(docs, text, [T.StructField(f"__{s}", T.DoubleType()) for s in STATS], make, keep)


# -- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic's number, whether above, threshold) for each term."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) if above else (x[:, k] <= at)
        return out

    def sql(self) -> str:
        return " and ".join(f"`__{STATS[k]}` {'>' if above else '<='} {at!r}D" for k, above, at in self.terms)


def _tightest(path: list[tuple[int, bool, float]]) -> tuple[tuple[int, bool, float], ...]:
    best: dict[tuple[int, bool], float] = {}
    for k, above, at in path:
        now = best.get((k, above))
        best[k, above] = at if now is None else max(now, at) if above else min(now, at)
    return tuple(sorted((k, above, at) for (k, above), at in best.items()))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds for each statistic: middles between neighbouring values at even shares of the rows."""
    out = []
    for c in x.T:
        v = np.unique(c)
        middles = (v[1:] + v[:-1]) / 2
        at = np.unique(np.searchsorted(middles, np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])).clip(0, max(len(middles) - 1, 0)))
        out.append(middles[at] if len(middles) else middles)
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3) -> list[Rule]:
    """The paths of boosted trees, each once."""
    cuts = _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    least, width = max(3, len(x) // 400), bins + 1
    p = np.clip(y.mean(), 0.01, 0.99)
    value = np.full(len(x), math.log(p / (1 - p)))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        g, h = y - p, p * (1 - p)
        nodes: list[tuple[np.ndarray, list]] = [(np.arange(len(x)), [])]
        for level in range(depth + 1):
            below = []
            for rows, path in nodes:
                if path:
                    found.setdefault(_tightest(path))
                split = _split(binned[rows], g[rows], h[rows], cuts, least, width) if level < depth and len(rows) >= 2 * least else None
                if split is None:
                    value[rows] += rate * g[rows].sum() / (h[rows].sum() + 1.0)
                    continue
                k, b = split
                above = binned[rows, k] > b
                below += [(rows[~above], [*path, (k, False, float(cuts[k][b]))]), (rows[above], [*path, (k, True, float(cuts[k][b]))])]
            nodes = below
    return [Rule(t) for t in found]


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], least: int, width: int) -> tuple[int, int] | None:
    best, at, total_g, total_h = 1e-3, None, g.sum(), h.sum()
    for k in range(binned.shape[1]):
        m = len(cuts[k])
        if not m:
            continue
        sums = [np.bincount(binned[:, k], w, minlength=width)[: m + 1].cumsum()[:-1] for w in (g, h, np.ones(len(g)))]
        gl, hl, nl = sums
        gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
        gain[(nl < least) | (len(g) - nl < least)] = 0
        b = int(gain.argmax())
        if gain[b] > best:
            best, at = gain[b], (k, b)
    return at


# -- lasso logistic regression -----------------------------------------------------------


def _loss(z: np.ndarray, n1: np.ndarray, n: np.ndarray) -> float:
    return float((n * np.logaddexp(0, z) - n1 * z).sum() / n.sum())


def _fit(x: np.ndarray, n1: np.ndarray, n: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps; x has a row for each distinct set of rules, n its rows and n1 those of label 1."""
    total = n.sum()
    full = np.column_stack([x, np.ones(len(x))])
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (n * (full @ v))
        v /= np.linalg.norm(v) or 1.0
    lip = 0.25 * float(v @ (full.T @ (n * (full @ v)))) / total + 1e-9
    old = cur = np.append(w, b)
    t = 1.0
    for _ in range(steps):
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = cur + (t - 1) / t2 * (cur - old)
        p = 1 / (1 + np.exp(-(full @ ahead)))
        new = ahead - full.T @ (n * p - n1) / total / lip
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / lip, 0)
        old, cur, t = cur, new, t2
    return cur[:-1], float(cur[-1])


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        terms = [repr(self.intercept) + "D"] + [f"if({r.sql()}, {w!r}D, 0D)" for r, w in zip(self.rules, self.weights, strict=True)]
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights from rows in a fixed order, every fifth of which is held aside to choose the penalty."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if len(y) < 20 or y.min() == y.max():
        return Ensemble([], [], base)
    aside = np.arange(len(y)) % 5 == 4
    rules = grow(x[~aside], y[~aside])
    held = np.column_stack([r.holds(x) for r in rules]) if rules else np.zeros((len(x), 0), bool)
    share = held.mean(axis=0)
    chosen, seen = [], set()
    for i in np.flatnonzero((share > 0.002) & (share < 0.998)):  # rules of the same rows count once
        key = np.packbits(held[:, i]).tobytes()
        if key not in seen:
            seen.add(key)
            chosen.append(int(i))
    rules, held = [rules[i] for i in chosen], held[:, chosen]
    if not rules:
        return Ensemble([], [], base)

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, at = np.unique(held[rows], axis=0, return_inverse=True)
        at = at.reshape(-1)
        return distinct.astype(np.float64), np.bincount(at, y[rows], len(distinct)), np.bincount(at, minlength=len(distinct)).astype(np.float64)

    gx, n1, n = grouped(~aside)
    start = float(np.abs(gx.T @ (n1 - n * (n1.sum() / n.sum()))).max() / n.sum())
    path, w, b = [], np.zeros(len(rules)), base
    own = held[aside].astype(np.float64)
    ya = y[aside]
    for penalty in start * np.geomspace(0.5, 0.003, 10):
        w, b = _fit(gx, n1, n, float(penalty), w, b)
        z = own @ w + b
        each = np.logaddexp(0, z) - ya * z
        path.append((float(penalty), float(each.mean()), float(each.std() / math.sqrt(len(each)))))
    best = min(path, key=lambda p: p[1])
    penalty = next(p for p in path if p[1] <= best[1] + best[2] / 4)[0]
    gx, n1, n = grouped(np.ones(len(y), bool))
    w, b = _fit(gx, n1, n, penalty, w, b, 400)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-6]
    return Ensemble([rules[i] for i in kept], [round(float(w[i]), 6) for i in kept], round(b, 6))


# -- over tables ---------------------------------------------------------------------------


def fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether the id's fold is held out; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 10_000, text: str = "text") -> Ensemble:
    """An ensemble from the texts and the labels outside of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & ~fold(F.col("__id"))).distinct()
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(train_rows)
    # at most train_rows ids are broadcast; only their texts go on, and a repeated id counts once
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col(f"`{text}`").alias("__t")).join(F.broadcast(chosen), "__id")
    one = with_stats(texts, "__t", ["__id", "__y"]).groupBy("__id", "__y").agg(*[F.max(f"__{s}").alias(f"__{s}") for s in STATS])
    rows = one.orderBy(F.xxhash64("__id"), "__id", "__y").limit(train_rows).collect()
    x = np.array([[r[f"__{s}"] for s in STATS] for r in rows], np.float64).reshape(len(rows), len(STATS))
    return fit(x, np.array([r["__y"] for r in rows], np.float64))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, train_rows: int = 10_000, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with held_out, score (0 to 1, higher: label 1 likelier) and predicted (0 or 1)."""
    names = ["held_out", "score", "predicted"]
    out = [c for c in (docs.columns if keep is None else keep) if c not in names]
    score = train(docs, labels, label, train_rows, text).score()
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none")).alias("__row"), F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("__t"))
    scored = with_stats(df, "__t", ["__row", "held_out"]).withColumn("score", score)
    return scored.select(*[F.col("__row")[c].alias(c) for c in out], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return classify(read("documents"), read("labels"), keep=["doc_id"])
