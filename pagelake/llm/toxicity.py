"""Toxicity: a convolutional text classifier trained in numpy, thresholds calibrated by language.

Words are hashed; frequent words of the training sample have an embedding of their own, rarer ones share that of their
beginning, and what the sample doesn't hold has the zero vector. Filters of several widths
slide over the whole text, their rectified outputs are max-pooled and a logistic unit gives the logit. The language is
guessed from the same word hashes (naive Bayes learnt on the training rows), and each guessed language has a calibrated
threshold, to which the score 0.5 is set. The sample of labelled rows is bounded by ``sample``; texts over ``LONGEST``
characters are not learnt from, but scored whole.

Cases: null and empty texts pool to zero and get a score all the same; without both labels in the sample every text
scores the base rate, and 1/3 without any label; repeated rows score alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import bucket
from pagelake.llm.ordinal import LONGEST

SAMPLE = 4000
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 6
_EDGES = b".,!?;:\"'()[]{}*|#$%&<>-_"


#: Words of fewer training texts than this are known by their beginnings, of so many bytes, instead.
OFTEN, SELDOM, PREFIXES = 5, 3, (7, 5)


def hashed(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings, longest first."""
    bare = word.strip(_EDGES)
    parts = [bare, *(bare[:n] for n in PREFIXES if len(bare) > n)]
    return [xxhash.xxh3_64_intdigest(x, i and len(x)) & 0x7FFFFFFFFFFFFFFF for i, x in enumerate(parts)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted hashes of known words; row i + 1 of the tables is that of keys[i], row 0 that of all others
    vectors: np.ndarray
    filters: list[np.ndarray]  # a width's: (width * dims, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    base: float
    languages: np.ndarray  # (rows, languages) log probabilities
    prior: np.ndarray
    shift: np.ndarray  # a language's logit at its threshold

    def pooled(self, ids: np.ndarray, starts: np.ndarray, want_places: bool = False):
        """Max over each text of every filter. ids: the texts' rows, each text followed by two rows of zero."""
        x = self.vectors[ids]
        pools, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            n = len(x) - w + 1
            y = sum(x[i : n + i] @ f[i * DIMS : (i + 1) * DIMS] for i in range(w)) + b
            y = np.vstack([y, np.full((w - 1, FILTERS), -1e9, y.dtype)]) if w > 1 else y
            pools.append(np.maximum.reduceat(y, starts, axis=0))
            if want_places:
                ends = np.append(starts[1:], len(ids))
                places.append(np.stack([s + y[s:e].argmax(0) for s, e in zip(starts, ends)]))
        return np.maximum(np.hstack(pools), 0), np.hstack(places) if want_places else None

    def guess(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return (np.add.reduceat(self.languages[ids], starts, axis=0) + self.prior).argmax(1)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        ids, starts = joined(rows)
        z = self.pooled(ids, starts)[0] @ self.out + self.base - self.shift[self.guess(ids, starts)]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.zeros(2, np.int64)
    sizes = np.array([len(r) + 2 for r in rows])
    return np.concatenate([x for r in rows for x in (r, gap)]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def train(texts: list[str], toxic: list[int], langs: list[str | None], epochs: int = EPOCHS, seed: int = 8) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    y = np.array(toxic, float)
    split = [words_of(t) for t in texts]
    whole, starts = Counter(), Counter()
    for words in split:
        chains = [hashed(w) for w in set(words)]
        whole.update({c[0] for c in chains})
        starts.update({h for c in chains for h in c[1:]})
    keys = np.array(sorted({h for h, n in whole.items() if n >= OFTEN} | {h for h, n in starts.items() if n >= SELDOM}), np.int64)
    known = KnownRows(keys)
    rows = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]
    n = len(keys) + 1
    # languages: naive Bayes of words
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = np.zeros((n, len(names)))
    for r, lang in zip(rows, langs):
        if lang is not None:
            np.add.at(counts[:, names.index(lang)], r, 1)
    counts[0] = 0
    logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * n))
    logs[0] = 0
    prior = np.log((np.array([sum(x == k for x in langs) for k in names]) + 1.0) / (len(langs) + len(names)))
    # embeddings: the first dimension starts from the smoothed log odds of the word among toxic texts, the others at random
    hits = np.zeros((n, 2))
    for r, t in zip(rows, toxic):
        hits[np.unique(r), t] += 1
    odds = np.log((hits[:, 1] + 0.5) / (y.sum() + 1)) - np.log((hits[:, 0] + 0.5) / (len(y) - y.sum() + 1))
    odds *= hits.sum(1) / (hits.sum(1) + 20)
    vectors = rng.normal(0, 0.05, (n, DIMS)).astype(np.float32)
    vectors[:, 0] = np.clip(odds, -2, 4) / 2
    vectors[0] = 0
    filters = [rng.normal(0, 0.2, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters):
        f[::DIMS, 0] = 1 / w
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1)))
    model = ToxicityModel(keys, vectors, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), base, logs.astype(np.float32), prior, np.zeros(len(names)))
    if len(y) and 0 < y.sum() < len(y):
        tune = np.arange(len(rows)) % 4 == 0  # thresholds come from texts that the weights haven't seen
        part = lambda keep: [r for r, k in zip(rows, keep) if k]
        _descend(model, part(~tune), y[~tune], epochs, rng)
        _calibrate(model, part(tune), y[tune])
    return model


def gradients(model: ToxicityModel, rows, y, weight) -> tuple[float, dict]:
    """The weighted logistic loss of some texts and its gradient by every parameter: pooled outputs pass theirs to the place that won."""
    ids, starts = joined(rows)
    pool, places = model.pooled(ids, starts, True)
    z = np.clip(pool @ model.out + model.base, -60, 60)
    loss = float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / len(rows))
    d = (1 / (1 + np.exp(-z)) - y) * weight / len(rows)
    back = d[:, None] * model.out[None, :] * (pool > 0)
    g = {"out": pool.T @ d, "base": d.sum(), "vectors": np.zeros_like(model.vectors)}
    for j, w in enumerate(WIDTHS):
        f, sl = model.filters[j], slice(j * FILTERS, (j + 1) * FILTERS)
        b, place = back[:, sl], places[:, sl]
        g_f = np.zeros_like(f)
        for i in range(w):
            row = ids[np.minimum(place + i, len(ids) - 1)]  # (texts, filters)
            g_f[i * DIMS : (i + 1) * DIMS] = np.einsum("tf,tfd->df", b, model.vectors[row])
            np.add.at(g["vectors"], row.ravel(), (b[:, :, None] * f[i * DIMS : (i + 1) * DIMS].T[None]).reshape(-1, DIMS))
        g["filters", j], g["biases", j] = g_f, b.sum(0)
    g["vectors"][0] = 0
    return loss, g


def _descend(model: ToxicityModel, rows, y, epochs, rng, rate: float = 0.02, batch: int = 100, decay: float = 1e-4) -> None:
    """Adagrad over balanced batches."""
    model.out[::FILTERS] = 1.0
    sums = {}

    def move(name, value, g):
        s = sums.setdefault(name, np.full(value.shape, 1e-3))
        s += g * g
        value -= (rate * g / np.sqrt(s)).astype(value.dtype)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            weight = np.where(y[pick] > 0, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
            _, g = gradients(model, [rows[i] for i in pick], y[pick], weight)
            for j in range(len(WIDTHS)):
                move(("f", j), model.filters[j], g["filters", j] + decay * model.filters[j])
                move(("b", j), model.biases[j], g["biases", j])
            move("v", model.vectors, g["vectors"])
            move("o", model.out, g["out"] + decay * model.out)
            base = np.array([model.base])
            move("c", base, np.array([g["base"]]))
            model.base = float(base[0])


def _calibrate(model: ToxicityModel, rows, y) -> None:
    """Per guessed language the logit between the two labels that errs least; languages with few of either take the overall one."""
    z, lang = [], []
    for at in range(0, len(rows), 200):
        ids, starts = joined(rows[at : at + 200])
        z.append(model.pooled(ids, starts)[0] @ model.out + model.base)
        lang.append(model.guess(ids, starts))
    z, lang = np.concatenate(z), np.concatenate(lang)

    def best(z, y):
        order = np.argsort(z)
        s, t = z[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
        low = np.flatnonzero(wrong == wrong.min())
        i = low[len(low) // 2]
        edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
        return 0.35 * edges[i] + 0.65 * edges[i + 1]  # nearer to the toxic side: clean texts vary more

    overall = best(z, y)
    for k in range(len(model.shift)):
        of = lang == k
        model.shift[k] = best(z[of], y[of]) if min(y[of].sum(), (1 - y[of]).sum()) >= 10 else overall


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from rows whose crc32 of the id, modulo 5, isn't 0: at most half of the sample toxic, the rest not."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & (bucket(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = None
    for label in (0, 1):
        part = rows.filter(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumnRenamed("doc_id", "the_id")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(picked), F.col("doc_id") == F.col("the_id")).filter(F.length("text") <= LONGEST).select("doc_id", "text", "lang", "y")
    got = sorted(found.collect(), key=lambda r: (r[0], r[1]))
    return train([r[1] for r in got], [int(r[3]) for r in got], [r[2] for r in got])


class KnownRows(dict):
    def __init__(self, keys: np.ndarray, limit: int = 500_000):
        super().__init__()
        self.known, self.limit = {int(k): i + 1 for i, k in enumerate(keys)}, limit

    def __missing__(self, word: bytes) -> int:
        value = next((self.known[h] for h in hashed(word) if h in self.known), 0)
        if len(self) < self.limit and len(word) < 64:
            self[word] = value
        return value


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = KnownRows(m.keys)
        for b in batches:
            scores, part, size = [], [], 0
            for t in b.text:
                words = words_of(t if isinstance(t, str) else "")
                part.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
                size += len(words) + 2
                if size > 50_000:
                    scores.append(m.score(part))
                    part, size = [], 0
            scores.append(m.score(part))
            s = np.concatenate(scores)
            yield pd.DataFrame({"doc_id": b.doc_id, "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")
