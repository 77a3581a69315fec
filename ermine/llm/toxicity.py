"""Operator 5, toxicity by class-conditional Kneser-Ney models.

Two character models (toxic, ordinary) over words padded as ``^word$``.  The highest
order is discounted Kneser-Ney per class; what it holds back goes to one lower-order
chain of continuation counts that both classes share, so a rare expression scores alike
in both.  A word's score is its log-likelihood ratio; a text is compared by ratios
normalised by length: over the whole text, over its worst window of ``WINDOW`` words, and
over its worst word.  A logistic regression, fitted out of fold on the training rows,
turns the three into a probability.

Training is bounded: of the labelled training rows, the ``per_class`` rows of each class
that come first by a hash of the id (all rows where there are fewer).  Only word counts
of these leave the executors, and only they are broadcast.  Every document is scored in
one pass without a shuffle.

Defined cases: null text is the empty text, which scores like any text without evidence;
labels other than 0 and 1, null included, are not used; an id with several labels or
rows trains with each pair; a null id is never held out and matches no label; without
training rows of both classes every score is 0; an empty table gives an empty result;
other columns are not read (``drop_toxic`` hands them on).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, pick

ORDER = 5          # characters of the longest n-gram
DISCOUNT = 0.75
WINDOW = 16        # words
PER_CLASS = 2000   # training rows of each class, at most
THRESHOLD = 0.3
FOLDS = 2
CACHE = 300_000    # words whose ratio a task remembers
STRIP = ".,;:!?\"'()[]{}|"


def words(text: str | None) -> list[str]:
    return [w for w in (x.strip(STRIP) for x in (text or "").lower().split()) if w]


class KneserNey:
    """Log-likelihood ratios from (toxic, ordinary) word counts."""

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER):
        self.order = order
        top: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for w, (a, b) in counts.items():
            for g in self.grams(w):
                t = top[g]
                t[0] += a
                t[1] += b
        self.top = dict(top)
        # per class and context: tokens and distinct followers
        self.context: dict[str, list[int]] = {}
        for g, (a, b) in top.items():
            c = self.context.setdefault(g[:-1], [0, 0, 0, 0])
            c[0] += a
            c[1] += b
            c[2] += a > 0
            c[3] += b > 0
        # shared chain: continuation counts of the next shorter gram, and so on down
        self.lower: list[tuple[Counter, Counter, Counter]] = []
        grams = set(top)
        while grams and (n := len(next(iter(grams)))) > 1:
            joined = Counter(g[1:] for g in grams)
            total, kinds = Counter(), Counter()
            for g, c in joined.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.lower.append((joined, total, kinds))
            grams = set(joined)
            assert n - 1 == len(next(iter(grams)))
        self.alphabet = max(2, len(self.lower[-1][0]) if self.lower else 2)
        self.seen: dict[str, float] = {}

    def grams(self, word: str):
        s = "^" * (self.order - 1) + word + "$"
        return (s[i:i + self.order] for i in range(len(s) - self.order + 1))

    def shared(self, gram: str, level: int = 0) -> float:
        """Interpolated Kneser-Ney of the last character, ``gram`` one shorter at each level."""
        if level == len(self.lower):
            return 1.0 / (self.alphabet + 1)
        joined, total, kinds = self.lower[level]
        below = self.shared(gram[1:], level + 1)
        if not (n := total[gram[:-1]]):
            return below
        return (max(joined[gram] - DISCOUNT, 0) + DISCOUNT * kinds[gram[:-1]] * below) / n

    def gram_ratio(self, gram: str) -> float:
        """log P(last | context, toxic) - log P(last | context, ordinary)."""
        if (r := self.seen.get(gram)) is None:
            r, c = 0.0, self.context.get(gram[:-1])
            if c:
                low, n, p = self.shared(gram[1:]), self.top.get(gram, (0, 0)), []
                for k in (0, 1):
                    p.append((max(n[k] - DISCOUNT, 0) + DISCOUNT * c[2 + k] * low) / c[k] if c[k] else low)
                r = math.log(p[0] / p[1])
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[gram] = r
        return r

    def word_ratio(self, word: str) -> float:
        return sum(map(self.gram_ratio, self.grams(word)))


def features(ratios: np.ndarray) -> list[float]:
    """Length-normalised ratios of a text's words: whole text, worst window, worst word."""
    n = len(ratios)
    if not n:
        return [0.0, 0.0, 0.0]
    w = min(WINDOW, n)
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    return [float(sums[-1] / n), float((sums[w:] - sums[:-w]).max() / w), float(ratios.max())]


class Scorer:
    """Texts -> probabilities, with a bounded memory of words."""

    def __init__(self, model: KneserNey, weights: np.ndarray | None):
        self.model, self.weights, self.memory = model, weights, {}

    def ratios(self, text: str | None) -> np.ndarray:
        memory, out = self.memory, []
        for w in words(text):
            r = memory.get(w)
            if r is None:
                if len(memory) >= CACHE:
                    memory.clear()
                r = memory[w] = self.model.word_ratio(w)
            out.append(r)
        return np.array(out, np.float64)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.weights[1:], features(self.ratios(text))) + self.weights[0])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; the intercept comes first."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)),
                               x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of the bounded training sample; ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    ids = None
    for k in (0, 1):
        one = (known.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
               .limit(per_class).select("doc_id", F.lit(k).alias("toxic")))
        ids = one if ids is None else ids.unionByName(one)
    # 2 * per_class ids: their size is bounded by the parameter
    return docs.join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    """The scorer trained on the bounded sample; ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    rows = training_rows(docs, labels, per_class)

    def count(batches):
        for b in batches:
            docid, text, toxic = (b.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
            out = []
            for d, t, k in zip(docid, text, toxic, strict=True):
                out += [(str(d), k, w, n) for w, n in Counter(words(t)).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)],
                                                 names=["id", "toxic", "word", "n"])

    counted = rows.mapInArrow(count, "id string, toxic long, word string, n long")
    # folds by id, so that the regression sees ratios from a model that did not learn the row
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    total = (counted.groupBy("word", fold.alias("fold"), "toxic").agg(F.sum("n").alias("n"))).toPandas()
    by = defaultdict(lambda: [0] * (2 * FOLDS))
    for w, f, k, n in total.itertuples(index=False):
        by[w][2 * f + k] += int(n)

    def model(without: int | None) -> KneserNey:
        pairs = {}
        for w, c in by.items():
            a = sum(c[2 * f + 1] for f in range(FOLDS) if f != without)
            b = sum(c[2 * f] for f in range(FOLDS) if f != without)
            if a or b:
                pairs[w] = (a, b)
        return KneserNey(pairs)

    folds = docs.sparkSession.sparkContext.broadcast([model(f) for f in range(FOLDS)])

    def judge(batches):
        scorers = [Scorer(m, None) for m in folds.value]
        for b in batches:
            out = [(k, *features(scorers[f].ratios(t))) for t, k, f in
                   zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)],
                                                 names=["toxic", "a", "b", "c"])

    fold_of = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = rows.select("text", "toxic", fold_of).mapInArrow(judge, "toxic long, a double, b double, c double").toPandas()
    x, y = sample[["a", "b", "c"]].to_numpy(), sample["toxic"].to_numpy()
    both = len(y) and 0 < y.sum() < len(y)
    return Scorer(model(None), fit_logistic(x, y) if both else None)


def _scored(docs: DataFrame, scorer: Scorer, text_col: str) -> DataFrame:
    """``docs`` with a last column ``toxicity`` (the docs' own names are not touched)."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer.model, scorer.weights))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        own = Scorer(*sent.value)
        for b in batches:
            s = pa.array([own.score(x.as_py()) for x in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, TOXICITY])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(TOXICITY, T.DoubleType())]))


TOXICITY = "__toxicity"


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    d, lab = pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id=id_col, toxic=label_col)
    out = _scored(d, fit(d, lab, per_class), "text")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col(TOXICITY).alias("score"),
                      (F.col(TOXICITY) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of ``docs`` whose score is below the threshold."""
    scorer = fit(pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id=id_col, toxic=label_col), per_class)
    return _scored(docs, scorer, text_col).where(F.col(TOXICITY) < threshold).drop(TOXICITY)
