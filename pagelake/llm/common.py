"""Shared helpers: tables, scratch tables in the shared folder, and the word rule.

A word is a run of characters other than space and U+0009 to U+000D; on UTF-8 bytes that is
exactly what ``bytes.split()`` returns, because those code points are the ASCII white space.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where spark.checkpoint.dir is unset and all runs in one process, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there,
    a lost executor loses nothing, and every later use reads the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucket(col, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound so that frequent words cost one lookup."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) < 64:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased. With fewer than ``width`` words the whole sequence is the one shingle;
    without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(width, n)
    total = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : n - w + 1 + i]
    return np.unique(mix(total))


def slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, texts[at:end]
        at = end
