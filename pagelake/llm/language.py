"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (white space as single spaces) in both directions and labels every position; the positions'
log probabilities are pooled over the whole text. States run across words. A text longer than ``SEGMENT`` bytes is read in
segments that are cut at white space, else between characters, and the states start anew in each. Trained in numpy by
backpropagation through time on stretches of ``STRETCH`` bytes of a bounded sample of rows: ``per_language`` rows of a
language, ``stretches`` of a row.

Cases: null text and text without a letter is `und` with score 0; without any labelled language every text is `und`;
very long texts and texts without white space are read whole; repeated rows get equal results; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import bucket, slices

PER_LANGUAGE = 300
STRETCHES = 12
HIDDEN = 10
SEGMENT, STRETCH = 256, 64
STEPS = 300
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def segments(text: bytes, most: int = SEGMENT) -> list[bytes]:
    """The text in runs of at most ``most`` bytes that together are the text, white space as single spaces."""
    data = b" ".join(text.split())
    out, at = [], 0
    while len(data) - at > most:
        end = data.rfind(b" ", at + most // 2, at + most) + 1
        if not end:
            end = at + most
            while end > at + most - 4 and data[end] & 0xC0 == 0x80:
                end -= 1
        out.append(data[at:end])
        at = end
    if at < len(data):
        out.append(data[at:])
    return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, words) byte values and the lengths; words sorted by length, longest first, by the caller."""
    n = np.array([len(w) for w in words])
    width = int(n.max())
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return np.ascontiguousarray(x.T), n


@dataclass
class GruModel:
    languages: list[str]
    p: dict[str, np.ndarray]

    def states(self, x: np.ndarray, n: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, runs, hidden) states of one direction. Each step touches only the runs that reach it. The gates have tables of
        their own, so that every array of a step is contiguous and small."""
        t_max, m = x.shape
        h = self.p[f"u{d}"].shape[0]
        out = np.zeros((t_max, m, h), np.float32)
        now = np.zeros((m, h), np.float32)
        half = np.float32(0.5)
        cut = lambda a: [np.ascontiguousarray(a[:, i * h : (i + 1) * h]) * w for i, w in enumerate((half, half, np.float32(1)))]
        (ez, er, ec), (uz, ur, uc) = cut(self.p[f"e{d}"]), cut(self.p[f"u{d}"])
        alive = np.searchsorted(-n, -np.arange(t_max), "left")  # runs longer than t, as lengths descend
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            k = alive[t]
            old, at = now[:k], x[t, :k]
            z = np.tanh(np.take(ez, at, axis=0) + old @ uz)  # sigmoid(v) is (1 + tanh(v / 2)) / 2
            z += 1
            z *= half
            reset = np.tanh(np.take(er, at, axis=0) + old @ ur)
            reset += 1
            reset *= half
            rc = old @ uc
            c = reset * rc
            c += np.take(ec, at, axis=0)
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, k, old.copy(), z, reset, c, rc))
            new = np.subtract(old, c)
            new *= z
            new += c
            out[t, :k] = new
            now[:k] = new
        return out

    def sums(self, runs: list[bytes], batch: int = 1536) -> np.ndarray:
        """Log probabilities summed over each run's positions."""
        out = np.zeros((len(runs), len(self.languages)), np.float32)
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, n = padded([runs[i] for i in pick])
            f, b = self.states(x, n, "f"), self.states(x, n, "b")
            for t in range(0, len(x), 16):  # labels of sixteen positions at once, a row a language; runs that have ended add nothing
                some = slice(t, min(t + 16, len(x)))
                logits = (f[some] @ self.p["of"] + b[some] @ self.p["ob"] + self.p["bias"]).reshape(-1, len(self.languages))
                logits = np.ascontiguousarray(logits.T)
                logits -= logits.max(0)
                logits -= np.log(np.exp(logits).sum(0))
                live = np.arange(some.start, some.stop)[:, None] < n[None, :]
                out[pick] += (logits.reshape(-1, *live.shape) * live).sum(1).T
        return out


def gradient(model: GruModel, runs: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of all positions, and its gradient by backpropagation through time. runs: longest first."""
    p, hidden = model.p, model.p["uf"].shape[0]
    x, n = padded(runs)
    kept = {"f": [], "b": []}
    h = {d: model.states(x, n, d, kept[d]) for d in "fb"}
    logits = h["f"] @ p["of"] + h["b"] @ p["ob"] + p["bias"]
    logits -= logits.max(-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(-1, keepdims=True)
    live = (np.arange(len(x))[:, None] < n[None, :]).astype(np.float32)
    loss = -float((np.log(np.maximum(prob[:, np.arange(len(runs)), y], 1e-30)) * live).sum() / live.sum())
    prob[:, np.arange(len(runs)), y] -= 1
    d_out = prob * (live / live.sum())[:, :, None]
    g = {"bias": d_out.sum((0, 1))}
    for d in "fb":
        g[f"o{d}"] = np.einsum("tmh,tml->hl", h[d], d_out)
        g[f"u{d}"], into_table, bytes_read = np.zeros_like(p[f"u{d}"]), [], []
        u, o = p[f"u{d}"], p[f"o{d}"]
        back = np.zeros((len(runs), hidden), np.float32)
        for t, k, old, z, reset, c, rc in reversed(kept[d]):  # back through time
            dh = back[:k] + d_out[t, :k] @ o.T
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (old - c) * z * (1 - z)
            dr = dc * rc * reset * (1 - reset)
            into = np.hstack([dz, dr, dc * reset])
            into_table.append(np.hstack([dz, dr, dc]))
            bytes_read.append(x[t, :k])
            g[f"u{d}"] += old.T @ into
            back[:k] = dh * z + into @ u.T
        read = np.concatenate(bytes_read)
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(read[order]) > 0]))
        g[f"e{d}"] = np.zeros_like(p[f"e{d}"])
        g[f"e{d}"][read[order][first]] = np.add.reduceat(np.concatenate(into_table)[order], first, axis=0)
    return loss, g


def train(words: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = 256, rate: float = 0.02, seed: int = 3) -> GruModel | None:
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"e{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        p[f"u{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, 0.3, (hidden, len(names))).astype(np.float32)
    p["bias"] = np.zeros(len(names), np.float32)
    model = GruModel(names, p)
    y_all = np.array([names.index(x) for x in langs])
    of = [np.flatnonzero(y_all == k) for k in range(len(names))]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, max(1, batch // len(names))) for o in of])
        pick = pick[np.argsort([-len(words[i]) for i in pick], kind="stable")]
        g = gradient(model, [words[i] for i in pick], y_all[pick])[1]
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            p[k] -= (rate * (1 - step / (steps + 1)) + 1e-4) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, stretches: int = STRETCHES) -> GruModel | None:
    """Learns from rows with text and lang whose crc32 of the id, modulo 4, isn't 2."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(bucket(F.col("doc_id"), 4), F.lit(0)) != 2))
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, per_language / r[1]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, lang, h in zip(b.text, b.lang, b.h):
                got = segments(t.encode("utf-8", "surrogatepass"), STRETCH)
                step = max(1, len(got) // stretches)
                out += [(int(h), i, lang, bytearray(x)) for i, x in enumerate(got[::step][:stretches])]
            yield pd.DataFrame(out, columns=["h", "i", "lang", "run"])

    picked = rows.filter(place < share[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    got = sorted((r[0], r[1], r[2], bytes(r[3])) for r in picked.mapInPandas(cut, "h long, i int, lang string, run binary").collect())
    return train([x for *_, x in got], [lang for _, _, lang, _ in got])


def text_sums(model: GruModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities and the number of positions of each text."""
    runs = [segments(t) for t in texts]
    n = np.array([sum(map(len, r)) for r in runs], np.int64)
    out = np.zeros((len(texts), len(model.languages)))
    full = [i for i, r in enumerate(runs) if r]
    if full:
        starts = np.concatenate([[0], np.cumsum([len(runs[i]) for i in full])[:-1]])
        out[full] = np.add.reduceat(model.sums([x for r in runs for x in r]).astype(np.float64), starts, axis=0)
    return out, n


def identify(docs: DataFrame, model: GruModel | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at, texts in slices(pc.fill_null(b.column("text"), ""), 2_000_000):
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m:
                    total, n = text_sums(m, texts.cast(pa.binary()).to_pylist())
                    total /= np.sqrt(np.maximum(n, 1))[:, None]
                    e = np.exp(total - total.max(1, keepdims=True))
                    best, top = total.argmax(1).tolist(), (e.max(1) / e.sum(1)).tolist()
                    for i, t in enumerate(texts.to_pylist()):
                        if _LETTER.search(t):
                            pred[i], score[i] = m.languages[best[i]], top[i]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
