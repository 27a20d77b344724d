"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers, floor(256 * x). A block of candidates is stored as bitmaps, one per attribute and bit. For a
query the slices of all attributes are added with bitmap arithmetic (carry-save adders over whole planes), which gives
the score of every row as bit slices; the top rows are then selected from the most significant slice downward, and the
rows that tie at the boundary are resolved exactly by vec_id. Queries and candidates meet in blocks of bounded size.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null
vec_id; vectors of different lengths are compared over zero-padded attributes; a query's candidates are all rows
but those of its own vec_id; rows that repeat a vec_id are ranked row by row; an empty table gives no rows; extra columns are ignored.
Every finite component is exact: rows whose integers need more than ``NARROW`` bits go to blocks of their own, where planes
are made from Python integers. Ranks follow the whole score; a score beyond 64 bits is null in the output.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import materialize

SCALE = 256
BLOCK = 1 << 15
QUERIES = 1 << 11
#: Bits of the integers that blocks of full size hold.
NARROW = 28


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double> of the rows that take part; they become integers in ``_matrix``."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), as_double.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))


class BitSlicedBlock:
    """Bitmaps of a block of rows, in ascending order of vec_id: planes[attribute, bit] are packed little-endian words."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        values = values[order]
        self.low = values.min(0)
        shifted = values - self.low
        self.bits = max(1, int(shifted.max()).bit_length())
        words = (self.n + 63) // 64
        planes = np.zeros((values.shape[1], self.bits, words * 8), np.uint8)
        for at in range(0, self.bits, 32):
            limb = (shifted >> at & 0xFFFFFFFF).astype(np.int64)
            for j in range(at, min(at + 32, self.bits)):
                packed = np.packbits((limb >> (j - at) & 1).astype(np.uint8), axis=0, bitorder="little")
                planes[:, j, : len(packed)] = packed.T
        self.planes = planes.view(np.uint64)
        everyone = np.zeros(words * 8, np.uint8)
        everyone[: (self.n + 7) // 8] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.everyone = everyone.view(np.uint64)

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum |q| * x', least significant first, and what to add to make them scores.

        x' is the attribute less the block's least value; where q is negative, its complement in ``bits`` bits."""
        top = (1 << self.bits) - 1
        constant = 0
        piles: list[list[tuple[np.ndarray, np.ndarray]]] = []
        size = np.abs(query)
        for i in range(int(size.max()).bit_length()):
            piles.append([])
            on = np.flatnonzero(size >> i & 1)
            piles[i] = (on, query[on] < 0)
        for d, q in enumerate(query.tolist()):
            constant += q * int(self.low[d]) + (q * top if q < 0 else 0)
        slices: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        weight = 0
        while weight < len(piles) + self.bits or carried:
            pile = carried
            for i, (on, negative) in enumerate(piles):
                j = weight - i
                if 0 <= j < self.bits and len(on):
                    p = self.planes[on, j]
                    if negative.any():
                        p[negative] = ~p[negative]
                    pile.append(p)
            stack = np.concatenate(pile) if pile else None
            carried = []
            if stack is None:
                slices.append(np.zeros_like(self.everyone))
            else:
                while len(stack) > 1:  # full adders three by three, a half adder for the last two
                    k = len(stack) // 3
                    if k:
                        a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                        ab = a ^ b
                        carried.append((a & b) | (ab & c))
                        stack = np.concatenate([ab ^ c, stack[3 * k :]])
                    else:
                        a, b = stack[:1], stack[1:2]
                        carried.append(a & b)
                        stack = a ^ b
                slices.append(stack[0])
            weight += 1
        return slices, constant

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[list[int], list[int]]:
        """vec_ids and scores, whole, of the k best rows other than the query's own; ties go to the smaller vec_id."""
        slices, constant = self.add(query)
        tied = self.everyone.copy()
        own = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        for r in range(*own):
            tied[r >> 6] &= ~np.uint64(1 << (r & 63))
        sure = np.zeros_like(tied)
        have = 0
        for s in reversed(slices):
            both = tied & s
            n = int(np.bitwise_count(both).sum())
            if have + n > k:
                tied = both
            else:
                sure |= both
                have += n
                tied = tied & ~s
                if have == k:
                    break
        rows = self._rows(sure)
        if len(rows) < k:
            rows = np.concatenate([rows, self._rows(tied)[: k - len(rows)]])
        scores = [sum(1 << i for i, s in enumerate(slices) if int(s[r >> 6]) >> (r & 63) & 1) + constant for r in rows.tolist()]
        best = sorted(zip(self.ids[rows].tolist(), scores), key=lambda x: (-x[1], x[0]))
        return [i for i, _ in best], [score for _, score in best]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        if not len(words):
            return np.zeros(0, np.int64)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        w, b = np.nonzero(bits)
        return words[w] * 64 + b


def _matrix(vectors, width: int, wide: bool = False) -> np.ndarray:
    """floor(256 * x), zero-padded, as Python integers if wide."""
    out = np.zeros((len(vectors), width), object if wide else np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [math.floor(x * SCALE) if abs(x) < 1 << 52 else int(x) * SCALE for x in v] if wide else np.floor(v * SCALE)
    return out


def _blocks(candidates: pd.DataFrame, width: int, block: int):
    """Bit-sliced blocks of rows of few bits, and smaller ones of wide rows, in order of size, as Python integers take about eight times the room."""
    most = np.array([np.abs(v).max() for v in candidates.v])
    wide = most >= 2.0 ** (NARROW - 8)
    narrow = candidates[~wide]
    for at in range(0, len(narrow), block):  # a block stays small even if ids repeat
        part = narrow.iloc[at : at + block]
        yield BitSlicedBlock(part.vec_id.to_numpy(), _matrix(part.v, width))
    order = np.flatnonzero(wide)[np.argsort(most[wide], kind="stable")]
    bits = np.frexp(most[order])[1] + 10
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * int(bits[end]) <= block * NARROW // 8:
            end += 1
        part = candidates.iloc[order[at:end]]
        yield BitSlicedBlock(part.vec_id.to_numpy(), _matrix(part.v, width, True))
        at = end


def _sortable(score: int) -> str:
    """Text that sorts as the whole number does."""
    digits = f"{abs(score):x}"
    key = f"{len(digits):04d}{digits}"
    return "1" + key if score >= 0 else "0" + key.translate(_COMPLEMENT)


_COMPLEMENT = str.maketrans("0123456789abcdef", "fedcba9876543210")
FOUND = "query_id long, vec_id long, score long, sortable string"


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, block: int = BLOCK) -> pd.DataFrame:
    found = []
    if len(candidates) and len(queries):
        width = max(max(map(len, candidates.v)), max(map(len, queries.v)))
        asked = [(i, _matrix([v], width, np.abs(v).max() >= 2.0 ** (NARROW - 8))[0]) for i, v in zip(queries.vec_id.tolist(), queries.v)]
        for index in _blocks(candidates, width, block):
            for query_id, vector in asked:
                found += [(query_id, i, score if -(1 << 63) <= score < 1 << 63 else None, _sortable(score)) for i, score in zip(*index.top(vector, query_id, k))]
    columns = zip(*found) if found else [[]] * 4
    return pd.DataFrame({n: pd.Series(list(c), dtype=t) for n, c, t in zip(("query_id", "vec_id", "score", "sortable"), columns, ("int64", "int64", "Int64", "object"))})


def search(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates. is_query: a condition on vec_id."""
    rows = materialize(quantised(vectors), "search-vectors")
    n = rows.count()
    asked = rows.filter(is_query)
    candidate_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked.count() // query_block))
    spread = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    # every block of candidates meets every block of queries: blocks are copied, not rows joined
    left = rows.withColumn("cb", spread(candidate_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("qb", spread(query_blocks).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(candidate_blocks - 1).cast("long"))))
    met = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(lambda c, q: _search(c, q, k, block), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("sortable"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
