"""Repeated passages by merging shard Burrows-Wheeler transforms.

A byte is removed if a 400-byte string that covers it also starts anywhere else. Texts are cut where equal strings must
meet: every 400-byte window has a key, the least hash among its 200-byte substrings, so equal windows share a key. A run of
windows of one key is a context. Contexts whose key occurs once are settled at once; the rest meet by key, equal
contexts as one row with its count.

The contexts of a task are dealt into shards. Each shard's suffixes are sorted once and give its transform, over symbols
of eight bytes (a suffix's predecessor starts eight bytes before it). The shards are merged without sorting suffixes
again: the interleave, which shard each row of the merged order comes from, starts as the shards one after another and is
refined by a symbol a pass, each pass dealing rows by the symbol before them. Where neighbours part first is their
common prefix; after fifty passes rows that have never parted share 400 bytes: a repeated interval.

A key with more than ``GROUP`` bytes of distinct contexts isn't put into one task: its contexts are cut anew by a longer
substring (``ANCHORS``), so that its windows part into smaller keys, and these are merged in the same way. The last substring
is the window itself: such a key has one window, and only its copies count. So a task's share is bounded whatever the data.

Cases: null text is empty; texts under 400 bytes lose nothing; texts without any repeat come back whole; repeated rows are
copies, so each loses all its bytes if it has 400; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import discard, materialize, mix, slices

LENGTH = 400
ANCHORS = (200, 300, 360, 390, 400)  # the first deals all texts, each other what the one before it left too large
STEP = 8  # bytes a symbol
PIECE = 4096  # windows a context at most
SHARD, TASK, GROUP = 1 << 15, 1 << 17, 1 << 22  # bytes
_BASE = 0x100000001B3
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sliding(f, x: np.ndarray, w: int, fill) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours, in two passes over blocks of w."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def runs_of_keys(data: bytes, anchor: int = ANCHORS[0], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first window, windows and weight of every run of windows with one key. The weight is 2 if the
    run's least substring occurs in it twice, so that the run may repeat a window of its own."""
    b = np.frombuffer(data, np.uint8)
    n, w = len(b), LENGTH - anchor + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    up, down = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    h = mix((prefix[anchor:] - prefix[:-anchor]) * down[: n - anchor + 1])
    m = sliding(np.minimum, h, w, np.uint64(0xFFFFFFFFFFFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(np.append(first, len(m)))
    key = m[first]
    # a place is an anchor if its hash is the least of some window that holds it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
    anchors = h[np.flatnonzero(sliding(np.maximum, padded, w, np.uint64(0)) == h)]
    twice = np.unique(anchors[1:][anchors[1:] == anchors[:-1]])
    weight = 1 + np.isin(key, twice)
    if count.max() > piece:  # long runs in pieces
        parts = -(-count // piece)
        i = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count, key, weight = first[i] + k * piece, np.minimum(piece, count[i] - k * piece), key[i], np.maximum(weight[i], 2)
    return key.view(np.int64), first, count, weight


class Shard:
    """Contexts' suffixes in sorted order (to 64 symbols) and their transform."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray):
        """starts, sizes: of the contexts in the task's buffer; symbols: the rank, from 1, of the eight bytes at each place."""
        n = int((sizes + 1).sum())
        ctx = np.repeat(np.arange(len(starts)), sizes + 1)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        at = np.arange(n) - base[ctx]
        left = sizes[ctx] - at
        self.place = starts[ctx] + at  # in the task's buffer, where each context has size + 1 places
        end = left < STEP
        self.ends = int(end.sum())
        sym = np.where(end, 0, symbols[self.place])
        rank = sym + self.ends
        rank[end] = np.arange(self.ends)  # ends differ from one another and come first
        order = None
        span = STEP
        for _ in range(7):  # doubling: 1, 2, 4 ... 64 symbols
            follow = np.where(left >= span, np.append(rank, np.zeros(span, rank.dtype))[np.minimum(np.arange(n) + span, n)], 0)
            pair = rank.astype(np.int64) * (int(rank.max()) + 2) + follow + 1
            order = np.argsort(pair, kind="stable")
            s = pair[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = new
            if rank[order[-1]] == n - 1 or span >= 32 * STEP:
                break
            span *= 2
        self.order = self.place[order]
        before = np.where(at >= STEP, np.concatenate([np.zeros(STEP, sym.dtype), sym])[:n], 0)
        self.bwt = before[order]


def merge(shards: list[Shard], depth: int = LENGTH // STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places in the merged order, and each row's common prefix, in symbols up to ``depth``, with the row before it."""
    bwt = np.concatenate([s.bwt for s in shards])
    n, ends = len(bwt), np.array([s.ends for s in shards])
    kind = np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 65536 else np.int64
    z = np.repeat(np.arange(len(shards), dtype=kind), [len(s.bwt) for s in shards])
    top = np.repeat(np.arange(len(shards), dtype=kind), ends)  # ends stay in the shards' order
    total = int(ends.sum())
    wide = int(bwt.max()) > 0xFFFF
    bwt = bwt.astype(np.uint32 if wide else np.uint16)
    parted = np.zeros(n, bool)
    parted[0] = True
    lcp = np.full(n, depth, np.int32)
    lcp[0] = 0
    for h in range(depth):
        c = np.empty(n, bwt.dtype)
        c[np.argsort(z, kind="stable")] = bwt  # each shard's rows in its own order
        if wide:
            deal = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
            deal = deal[np.argsort((c[deal] >> 16).astype(np.uint16), kind="stable")]
        else:
            deal = np.argsort(c, kind="stable")
        block = np.cumsum(parted)
        c, b = c[deal], block[deal]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        new[:total] = True
        if total < n:
            new[total] = True
        z_new = z[deal]
        z_new[:total] = top
        fresh = new & (lcp == depth)
        lcp[fresh] = h
        same = not fresh.any() and np.array_equal(z, z_new)
        z, parted = z_new, new
        if same:
            break
    places = np.empty(n, np.int64)
    places[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return places, lcp


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """Of each context, the windows (their first bytes) that also occur elsewhere in these contexts."""
    sizes = np.array([len(c) for c in contexts])
    buffer = np.frombuffer(b"".join(c + b"\0" for c in contexts) + b"\0" * STEP, np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    eight = np.lib.stride_tricks.sliding_window_view(buffer, STEP)
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    symbols = np.unique(words, return_inverse=True)[1].ravel() + 1
    shards, part, held = [], [], 0
    for i in range(len(contexts)):
        part.append(i)
        held += sizes[i]
        if held >= SHARD or i == len(contexts) - 1:
            shards.append(Shard(starts[part], sizes[part], symbols))
            part, held = [], 0
    places, lcp = merge(shards)
    deep = lcp >= LENGTH // STEP
    hit = deep.copy()
    hit[:-1] |= deep[1:]
    flags = np.zeros(len(buffer), bool)
    flags[places[hit]] = True
    return [np.flatnonzero(flags[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist())]


def intervals(windows: np.ndarray) -> tuple[list[int], list[int]]:
    """What the windows cover, as first bytes and ends."""
    if not len(windows):
        return [], []
    cut = np.flatnonzero(np.diff(windows) > LENGTH)
    return windows[np.concatenate([[0], cut + 1])].tolist(), (windows[np.append(cut, len(windows) - 1)] + LENGTH).tolist()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        th = b.column("th")
        for at, texts in slices(b.column("text")):
            found = [runs_of_keys(t) for t in texts.cast(pa.binary()).to_pylist()]
            which = np.repeat(np.arange(at, at + len(found)), [len(f[0]) for f in found])
            key, first, count, weight = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(key), th.take(pa.array(which)), *(pa.array(x.astype(np.int32)) for x in (first, count, weight))], ["key", "th", "first", "windows", "weight"])


CONTEXT = ["key", "ch", "th", "first", "copies", "bytes"]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        th, copies, runs = b.column("th"), b.column("copies"), [b.column(c) for c in ("keys", "firsts", "counts")]
        for at, texts in slices(b.column("text"), 2_000_000):
            which, key, first, data = [], [], [], []
            for i, text in enumerate(texts.cast(pa.binary()).to_pylist(), at):
                k, f, n = (c[i].values.to_numpy() for c in runs)
                which += [i] * len(k)
                key.append(k), first.append(f)
                data += [text[a : a + m + LENGTH - 1] for a, m in zip(f.tolist(), n.tolist())]
            which = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key)), pa.array([xxhash.xxh3_128_digest(x) for x in data], pa.binary()), th.take(which), pa.array(np.concatenate(first)), copies.take(which), pa.array(data, pa.binary())], CONTEXT
            )


def _merge_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's contexts are never parted."""
    ints = pa.list_(pa.int32())

    def settle(rows):
        found = repeated_windows([r[3] for r in rows]) if rows else []
        out = []
        for (key, ch, n, data), windows in zip(rows, found):
            a, e = ([0], [len(data)]) if n > 1 else intervals(windows)
            if a:
                out.append((key, ch, a, e))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), ints, ints))], ["key", "ch", "a", "e"])

    held, size, last = [], 0, None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "ch", "n", "bytes"))):
            if size >= TASK and row[0] != last:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    yield settle(held)


def _cut_anew(anchor: int):
    """Contexts of too large keys as contexts of a longer anchor; th names the context they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                parent, copies, data = b.column("th")[i], b.column("n")[i], b.column("bytes")[i].as_py()
                key, first, count, _ = runs_of_keys(data, anchor, 1 if anchor == LENGTH else PIECE)
                for at in range(0, len(key), 2000):
                    f, m = first[at : at + 2000].tolist(), count[at : at + 2000].tolist()
                    parts = [data[x : x + k + LENGTH - 1] for x, k in zip(f, m)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at : at + 2000]), pa.array([xxhash.xxh3_128_digest(x) for x in parts], pa.binary()), pa.array([parent.as_py()] * len(f), pa.binary()), pa.array(f, pa.int32()), pa.array([copies.as_py()] * len(f), pa.int64()), pa.array(parts, pa.binary())],
                        CONTEXT,
                    )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        firsts, ends = b.column("a"), b.column("e")
        for at, texts in slices(b.column("text")):
            out = []
            for i, data in enumerate(texts.cast(pa.binary()).to_pylist(), at):
                kept, removed, n, stop = hashlib.sha256(), 0, 0, -1
                for a, e in sorted(zip(firsts[i].as_py(), ends[i].as_py())):
                    if a > stop:  # spans that touch are one
                        n += 1
                        kept.update(data[max(stop, 0) : a])
                        removed += e - a
                    else:
                        removed += max(0, e - stop)
                    stop = max(stop, e)
                kept.update(data[max(stop, 0) :])
                out.append((removed, n, kept.hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("th").slice(at, len(out)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["th", "n_removed", "n_spans", "kept"])


CONTEXTS = "key long, ch binary, th binary, first int, copies long, bytes binary"


def _spans(placed: DataFrame, level: int = 0) -> DataFrame:
    """th, a, e: of each th the removed stretches of its contexts. placed: a written table of contexts."""
    distinct = placed.groupBy("key", "ch").agg(F.any_value("bytes").alias("bytes"), F.sum("copies").alias("n"))
    distinct = materialize(distinct, "repeat-distinct")
    # an exchange of its own for both sides: a key with many contexts can then be dealt over several tasks
    sizes = materialize(distinct.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count("*").alias("m")).select(F.col("key").alias("sk"), "size", "m"), "repeat-sizes")
    joined = distinct.join(sizes, F.col("key") == F.col("sk"))
    lone = joined.filter("m = 1 and n > 1").select("key", "ch", F.array(F.lit(0)).alias("a"), F.array(F.octet_length("bytes").cast("int")).alias("e"))
    last = level + 1 == len(ANCHORS)
    small = F.lit(False) if last else F.col("size") <= GROUP
    few = joined.filter("not (m = 1 and n > 1)").filter(small).select("key", "ch", "n", "bytes")
    ways = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = few.repartition(ways, "key").sortWithinPartitions("key", "ch").mapInArrow(_merge_tasks, "key long, ch binary, a array<int>, e array<int>")
    results, scratch = lone.unionByName(merged), [distinct, sizes]
    if not last and not sizes.filter(F.col("size") > GROUP).isEmpty():
        many = joined.filter(F.col("size") > GROUP).filter("not (m = 1 and n > 1)").select(F.concat(F.unhex(F.lpad(F.hex("key"), 16, "0")), "ch").alias("th"), "n", "bytes")
        parts = materialize(many.mapInArrow(_cut_anew(ANCHORS[level + 1]), CONTEXTS), "repeat-contexts")
        deeper = _spans(parts, level + 1).groupBy("th").agg(F.collect_set(F.struct("a", "e")).alias("s"))
        key = F.conv(F.hex(F.substring("th", 1, 8)), 16, -10).cast("long")
        results = results.unionByName(deeper.select(key.alias("key"), F.expr("substring(th, 9)").alias("ch"), F.col("s.a").alias("a"), F.col("s.e").alias("e")))
        scratch.append(parts)
    results = materialize(results.select(F.col("key").alias("qk"), F.col("ch").alias("qc"), "a", "e"), "repeat-results")
    discard(*scratch)
    back = placed.select("key", "ch", "th", "first").join(results, (F.col("key") == F.col("qk")) & (F.col("ch") == F.col("qc")))
    return back.select("th", "first", F.explode(F.arrays_zip("a", "e")).alias("s")).select("th", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.e")).alias("e"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with a possible repeat (th, text, copies and their runs), and the spans to remove of each th."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.unhex(F.md5("text")))
    long = rows.filter(F.octet_length("text") >= LENGTH)
    runs = materialize(long.mapInArrow(_anchors, "key long, th binary, first int, windows int, weight int"), "repeat-runs")
    keys = materialize(runs.groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 1").select(F.col("key").alias("rk")), "repeat-keys")
    shared = runs.join(keys, F.col("key") == F.col("rk")).groupBy("th").agg(F.collect_set(F.struct("key", "first", "windows")).alias("runs"))
    shared = shared.select(F.col("th").alias("sh"), F.col("runs.key").alias("keys"), F.col("runs.first").alias("firsts"), F.col("runs.windows").alias("counts"))
    classes = long.groupBy("th").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    texts = materialize(classes.join(shared, F.col("th") == F.col("sh")).select("th", "text", "copies", "keys", "firsts", "counts"), "repeat-texts")
    discard(runs, keys)
    placed = materialize(texts.mapInArrow(_contexts, CONTEXTS), "repeat-contexts")
    spans = _spans(placed).select("th", F.struct("a", "e").alias("s"))
    return texts, spans.groupBy("th").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, spans = repeated_spans(docs)
    with_spans = texts.select("th", "text").join(spans.select(F.col("th").alias("sh"), "spans"), F.col("th") == F.col("sh")).select("th", "text", F.col("spans.a").alias("a"), F.col("spans.e").alias("e"))
    changed = materialize(with_spans.mapInArrow(_cut, "th binary, n_removed long, n_spans long, kept string"), "repeat-changed").withColumnRenamed("th", "ct")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), F.unhex(F.md5(text)).alias("th"))
    out = rows.join(changed, F.col("th") == F.col("ct"), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
