"""Best-fit packing of token sequences by minimum bin slack.

Pieces are counted by exact length: at most ``capacity`` different lengths, whatever the data's size. For each bin the
longest remaining length is placed and a bitset subset-sum over the remaining lengths finds the fullest feasible
completion; that combination is then used as often as the counts allow and removed. Pieces get a rank within their
length from hash buckets, and the rank names the sequence and offset, so no task gathers a length's pieces.

Cases: null text is the empty text, whose only token is the end id; repeated rows are packed each; null ids
are carried through; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import materialize, slices

CAPACITY = 4096
END = 1
#: Pieces of a length are ranked by hash bucket; with more pieces than these hold there are more buckets.
BUCKETS, PER_BUCKET = 256, 1 << 18
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_KNOWN: dict[str, "WordTokens"] = {}  # of this Python worker, for its next task


class WordTokens(dict):
    """word (UTF-8 bytes between ASCII white space) -> its ids as little-endian bytes. The tokenizer drops white space and
    ends words there, so a text's ids are its words' ids in order; only words not yet seen reach the tokenizer, many at a time."""

    def __init__(self, path: str, limit: int = 1_200_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: list[bytes]) -> None:
        # the tokenizer lower-cases and parts letters from a stop or comma, so such words share their bare word's ids
        plain, others, bare = {b".": 0, b",": 0}, [], []
        for w in words:
            stop = w[-1:] if w[-1:] in (b".", b",") else b""
            b = (w[:-1] if stop else w).lower()
            if b.isalpha() or b.decode("utf-8", "replace").isalpha():
                plain[b] = 0
                if b != w:
                    bare.append((w, b, stop))
            else:
                others.append(w)
        new = [x for x in plain if x not in self]
        for i in range(0, len(new), 2048):  # letters only: one call for many words, parted at the ids that end a word
            part = new[i : i + 2048]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part) or b"." in part or b"," in part:
                others += part
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))
        for i in range(0, len(others), 256):
            part = others[i : i + 256]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)):
                self[w] = np.array(e.ids, "<u4").tobytes()
        for w, b, stop in bare:
            self[w] = self[b] + self[stop] if stop else self[b]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct, place = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        if len(self) > self.limit:
            self.clear()
        found = [*map(self.get, distinct)]
        if None in found:
            self.learn([w for w, x in zip(distinct, found) if x is None])
            found = [*map(self.__getitem__, distinct)]
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        n = size[place]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[place] - after[:-1], n) + np.arange(after[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, after[offsets - offsets[0]]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path = tokenizer or default_tokenizer()
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.get(path) or _KNOWN.setdefault(path, WordTokens(path))
        for b in batches:
            for at, texts in slices(pc.fill_null(b.column("text"), "")):
                ids, bounds = known.encode(texts)
                rows: list[tuple] = []
                for i, (a, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), at):
                    raw = ids[a:e].tobytes() + tail
                    for k in range(0, len(raw), 4 * capacity):
                        part = raw[k : k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))


def fill_bin(counts: dict[int, int], lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination that holds the longest remaining length: [(length, how many)]. lengths: descending."""
    first = lengths[0]
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    if room:
        for length in lengths:
            if length > room:
                continue
            free, unit = min(counts[length] - (length == first), room // length), 1
            while free > 0:
                k = min(unit, free)
                steps.append((length, k, reach))
                reach |= reach << (k * length) & mask
                free -= k
                unit *= 2
            if reach >> room & 1:
                break
    at, used = reach.bit_length() - 1, {first: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many bins, combination)] that use every piece of the histogram."""
    counts = dict(histogram)
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    bins = []
    while lengths:
        combo = fill_bin(counts, lengths, capacity)
        times = min(counts[length] // k for length, k in combo)
        bins.append((times, combo))
        gone = set()
        for length, k in combo:
            counts[length] -= times * k
            if not counts[length]:
                gone.add(length)
        if gone:
            lengths = [x for x in lengths if x not in gone]
    return bins


def _slots(bins) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, pieces a bin, first sequence, offset in the bin) of each combination, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, combo in bins:
        offset = 0
        for length, k in combo:
            out.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, capacity, end, tokenizer)
    pieces = materialize(pieces, "pack-pieces")
    buckets = max(BUCKETS, pieces.count() // PER_BUCKET)
    pieces = pieces.withColumn("hb", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    hist = materialize(pieces.groupBy("length", "hb").agg(F.count("*").alias("n")), "pack-histogram")
    lengths = {int(r[0]): int(r[1]) for r in hist.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan_bins(lengths, capacity)))
    upto = Window.partitionBy("length").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(hist.select("length", "hb", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")), "pack-before")
    rank = Window.partitionBy("length", "hb").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(rank)).join(before, ["length", "hb"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("r"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            length, r = b.length.to_numpy(), b.r.to_numpy()
            for x in np.unique(length):
                first, k, base, start = table[int(x)]
                rows = np.flatnonzero(length == x)
                i = np.searchsorted(first, r[rows], "right") - 1
                within = r[rows] - first[i]
                sequence[rows] = base[i] + within // k[i]
                offset[rows] = start[i] + within % k[i] * x
            yield b.drop(columns="r").assign(sequence_id=sequence, offset=offset)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, PIECES.format(kind) + ", sequence_id long, offset long")
