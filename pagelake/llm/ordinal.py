"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the mean weight of its words; a word's weight is that of its hash plus that of its hashed shape
(letter case, digits, punctuation; runs collapsed), and the share of words that repeat the word before has a weight too. One shared weight vector serves every grade, and ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). Trained in numpy with Adam on a bounded
sample of labelled rows; ``sample`` is the bound, and texts over ``LONGEST`` characters are not learnt from. Rows whose
crc32 of the id, modulo 5, is 0 are held out: no model learns from them. All texts are scored whole.

Cases: a text without words, or null, gets the score 0; with fewer than two grades among the labels every text
gets the one grade (or null without labels) and is kept; repeated rows score alike; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import bucket

SAMPLE = 4000
LONGEST = 20_000
BITS = 18
EPOCHS = 150
CUT = 0.5
_RUNS = re.compile(rb"(.)\1+", re.S)
# Upper case A, lower case a, digits 0, bytes above ASCII a; the rest stand for themselves.
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 48 if 48 <= i <= 57 else i for i in range(256))


def word_keys(word: bytes) -> tuple[int, int]:
    mask = (1 << BITS) - 1
    shape = _RUNS.sub(rb"\1", word[:64].translate(_SHAPE))
    return zlib.crc32(word.lower()) & mask, (zlib.crc32(shape, 7) & mask) + mask + 1


REPEAT = 2 << BITS  # the place of the weight of repeated words


def repeats(words: list[bytes]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade) of each score, a column a grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(edges, axis=1)


def gradient(p, y, doc, share, col, balance, used: int, decay: float) -> tuple[float, np.ndarray]:
    """The balanced negative log likelihood, with its decay, and its gradient. p: the words' weights, the first threshold and the logs of
    the steps to the next ones, which keeps them in order; share: of word ``col`` in text ``doc``; y: grades from 0."""
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    w, theta = p[:used], p[used:]
    n, k = len(y), len(theta)
    cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    score = np.bincount(doc, share * w[col], n) * 4
    up = np.where(y < k, sig(np.append(cuts, 0)[np.minimum(y, k)] - score), 1.0)
    low = np.where(y > 0, sig(cuts[np.maximum(y - 1, 0)] - score), 0.0)
    prob = np.maximum(up - low, 1e-9)
    loss = -float((balance * np.log(prob)).sum()) / n + decay * float(w @ w) / 2
    gu, gl = np.where(y < k, up * (1 - up), 0) / prob * balance, np.where(y > 0, low * (1 - low), 0) / prob * balance
    g_w = np.bincount(col, share * ((gu - gl) / n)[doc] * 4, used) + decay * w
    g_cut = -np.bincount(np.minimum(y, k - 1), np.where(y < k, gu, 0), k) / n + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, gl, 0), k) / n
    g_theta = np.concatenate([[g_cut.sum()], [g_cut[j:].sum() * np.exp(theta[j]) for j in range(1, k)]])
    return loss, np.concatenate([g_w, g_theta])


def train(texts: list[str], ratings: list[int], epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-6, seed: int = 5) -> OrdinalModel | None:
    """Maximum likelihood of the cumulative-link model. None without labels; one grade gives no thresholds."""
    grades = sorted({int(r) for r in ratings})
    size = REPEAT + 1
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(size, np.float32), np.zeros(0)) if grades else None
    y = np.searchsorted(grades, ratings)
    keys, docs, shares = [], [], []
    for i, t in enumerate(texts):
        words = words_of(t)
        if words:
            k = np.array([x for w in words for x in word_keys(w)])
            u, n = np.unique(k, return_counts=True)
            u, n = np.append(u, REPEAT), np.append(n, repeats(words))
            keys.append(u), docs.append(np.full(len(u), i)), shares.append(n / len(words))
    if not keys:
        keys, docs, shares = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    used, col = np.unique(np.concatenate(keys), return_inverse=True)
    doc, share = np.concatenate(docs), np.concatenate(shares)
    theta = np.zeros(len(grades) - 1)
    balance = (len(y) / len(grades) / np.bincount(y, minlength=len(grades)))[y]
    p = np.concatenate([np.zeros(len(used)), theta])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, epochs + 1):
        _, g = gradient(p, y, doc, share, col, balance, len(used), decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[used] = 4 * p[: len(used)]
    theta = p[len(used) :]
    return OrdinalModel(grades, weights, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, where=None) -> DataFrame:
    """At most ``sample`` labelled rows (text, label) by a hash of the id; the ids joined to documents are that many at most."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        ids = ids.filter(where)
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("the_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").alias("the_id"), "text").join(F.broadcast(ids), F.col("the_id") == F.col("doc_id")).filter(F.length("text") <= LONGEST).select("doc_id", "text", "the_label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> OrdinalModel | None:
    """Learns from labelled rows whose crc32 of the id, modulo 5, isn't 0."""
    rows = sorted(labelled_sample(docs, labels, label, sample, bucket(F.col("doc_id"), 5) != 0).collect(), key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows])


class WordWeights(dict):
    """word -> its weight, remembered up to a bound."""

    def __init__(self, weights: np.ndarray, limit: int = 500_000):
        super().__init__()
        self.weights, self.limit, self.again = weights, limit, float(weights[REPEAT])

    def score(self, text: str | None) -> float:
        words = words_of(text if isinstance(text, str) else "")
        return (sum(map(self.__getitem__, words)) + self.again * repeats(words)) / len(words) if words else 0.0

    def __missing__(self, word: bytes) -> float:
        a, b = word_keys(word)
        value = float(self.weights[a] + self.weights[b])
        if len(self) < self.limit and len(word) < 64:
            self[word] = value
        return value


def grade(docs: DataFrame, model: OrdinalModel | None, cut: float = CUT) -> DataFrame:
    """doc_id, text and score, expected_grade, tail_prob = P(grade >= the highest), kept = tail_prob >= cut, of every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = WordWeights(m.weights) if m else None
        for b in batches:
            score = np.zeros(len(b))
            for i, t in enumerate(b.text if m else ()):
                score[i] = table.score(t)
            out = b[["doc_id"]].copy()
            out["score"] = score
            if m:
                probs = m.probabilities(score)
                out["expected_grade"], out["tail_prob"] = probs @ np.array(m.grades, float), probs[:, -1]
                out["kept"] = out.tail_prob >= cut
            else:
                out["expected_grade"], out["tail_prob"], out["kept"] = np.nan, np.nan, True
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, expected_grade double, tail_prob double, kept boolean")


def keep_good(docs: DataFrame, model: OrdinalModel | None, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose tail probability reaches the cut."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        table = WordWeights(m.weights) if m else None
        for part in texts:
            if m is None:
                yield pd.Series(True, index=part.index)
                continue
            score = np.array([table.score(t) for t in part], float)
            yield pd.Series(m.probabilities(score)[:, -1] >= cut, index=part.index)

    return docs.filter(good("text"))
