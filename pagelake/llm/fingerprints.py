"""Document fingerprints by MinHash: universal hash permutations over word shingles, in vectorised numpy.

A fingerprint is the minimum, over a text's set of five-word shingles, of each of ``PERMUTATIONS`` universal hash
functions, written as hex. The likeness of two fingerprints is the share of equal minima, an estimate of the Jaccard
similarity of the sets. ``similar_documents`` joins signature bands in Spark and verifies candidates on whole sets.

Cases: null text is empty; texts without words share the empty set's fingerprint, which is like itself alone; rows with
a null id come last in descending order; among equal ids the order is that of a hash of the row; in a table of one row
the next document is the row itself; repeated rows each give their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import WordHashes, materialize, shingle_set

PERMUTATIONS = 128
SEED = 10
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64)
_HASHES: list[WordHashes] = []  # of this Python worker, for its next task


def word_hashes() -> WordHashes:
    if not _HASHES:
        _HASHES.append(WordHashes())
    return _HASHES[0]


def minima(shingles: np.ndarray, permutations: int = PERMUTATIONS, chunk: int = 512) -> np.ndarray:
    """The least value of each permutation (multiply-shift, 32 bits) over the set; all ones for the empty set."""
    a, b = _A[:permutations, None], _B[:permutations, None]
    low = np.full(permutations, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), chunk):
        np.minimum(low, (a * shingles[None, i : i + chunk] + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_hex(m: np.ndarray) -> str:
    return m.astype(">u4").tobytes().hex()


def _range_of(bounds: list[int], nulls: int):
    """The range of a row by doc_id and h, ascending: ``nulls`` ranges of null ids, then for each bound one of the ids before it and as
    many of the id itself as it occurs among the bounds, each parted by h. So rows that share an id do not meet in one range."""
    counts = Counter(bounds)
    ids = sorted(counts)
    part = lambda n: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)
    if not ids:
        return F.when(F.col("doc_id").isNull(), part(F.lit(nulls))).otherwise(F.lit(nulls))
    offsets = list(itertools.accumulate([nulls] + [1 + counts[i] for i in ids]))
    wide = max(1, int(len(ids) ** 0.5))  # two steps of a search, each over about the root of the bounds
    blocks = [ids[i : i + wide] for i in range(0, len(ids), wide)]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    under = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("doc_id")))
    block = under(longs(b[-1] for b in blocks))
    place = F.least(block * wide + F.coalesce(under(F.get(F.array(*map(longs, blocks)), block)), F.lit(0)), F.lit(len(ids)))
    times = F.when(F.get(longs(ids), place) == F.col("doc_id"), F.get(longs(counts[i] for i in ids), place).cast("int"))
    of_id = F.get(longs(offsets), place).cast("int") + F.coalesce(1 + part(times), F.lit(0))
    return F.when(F.col("doc_id").isNull(), part(F.lit(nulls))).otherwise(of_id)


def successors(docs: DataFrame) -> DataFrame:
    """Rows (p, tail, doc_id, text, h) dealt by ranges of doc_id. In each p, sorted by tail, doc_id descending and h
    descending, every row is followed by its next document: the tail row is a copy of the next range's first row.

    The ranges' bounds and first ids, a row a range, are all that reaches the driver."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * tasks  # several a task, so that tasks come out even
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    dealt = rows.select(_range_of(found[0] or [], max(1, -(-found[1] * ranges // max(1, found[2])))).alias("p"), "doc_id", "text", "h")
    heads = dealt.groupBy("p").agg(F.max(F.struct("doc_id", "h")).alias("m")).select("p", "m.doc_id", "m.h").collect()
    heads.sort(key=lambda r: -r[0])
    follows = [(heads[i - 1][0], heads[i][1], heads[i][2]) for i in range(len(heads))]  # this head ends the range before it; the first ends the last
    ends = spark.createDataFrame(follows, "tp int, t_id long, t_h long").dropDuplicates()
    marked = dealt.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left")
    both = F.when(F.col("tp").isNull(), F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("tail")), F.struct(F.col("tp").alias("p"), F.lit(1).alias("tail")))
    )
    spread = marked.select(F.explode(both).alias("at"), "doc_id", "text", "h").select("at.p", "at.tail", "doc_id", "text", "h")
    return spread.repartition(tasks, "p").sortWithinPartitions("p", "tail", F.desc_nulls_last("doc_id"), F.desc("h"))


def fingerprint_with_edit(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes()
        sign = lambda t: minima(shingle_set(t, hashes), permutations)
        before = None
        for b in batches:
            out = []
            for p, tail, doc_id, text in zip(b["p"], b["tail"], b["doc_id"], b["text"]):
                if before is None and tail:
                    continue
                mine = sign(text)
                if before is not None and before[0] == p:
                    out.append(_row(*before[1:], text, mine, sign))
                before = None if tail else (p, doc_id, text, mine)
            yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return successors(docs).select("p", "tail", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the next document's beginning."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _row(doc_id, text, mine, following, theirs, sign):
    new = edited(text, following)
    other = mine if new == text else sign(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(mine), as_hex(other), likeness(mine, other), likeness(mine, theirs)


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of similar documents from the same permutations. Bands of four of a fingerprint's
    minima are joined in Spark, and the Jaccard similarity of candidates is verified on their whole sets."""
    from pagelake.llm.near_dedup import near_duplicates

    return near_duplicates(docs, **options)
