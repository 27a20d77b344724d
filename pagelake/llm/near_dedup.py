"""Near-duplicates by b-bit MinHash.

1. Each text's set of five-word shingles gives 256 minima. Bands of four of the first 128 are the candidate keys; of every
   minimum the low four bits are kept, packed into sixteen 64-bit words.
2. Texts with equal sets form a class, which its least doc_id stands for.
3. In every band bucket each class is paired with the bucket's least one: a star, never all pairs. The packed bits give
   a collision-corrected estimate by bit counts, which discards pairs far below the threshold; the rest are confirmed
   on the full sets. Links are joined into components.
4. Buckets that still hold several components are taken again. Shingles that a single open text has are in no intersection,
   which bounds every similarity from above and sets aside the members that cannot have a link. Members outside a bucket's
   largest component are compared with the others, unless those are too many pairs, when a star is laid from another
   member first. This repeats until every pair of a bucket lies inside one component, is ruled out by the bound or the
   estimate, or has been compared, so no link between texts of a bucket is lost.

Cases: null text and text without words has the empty set and is linked with nothing; rows that share an id are one
node; a row with a null id takes part by its text, and is kept only if its component names no id; a table without rows
gives no rows; extra columns are ignored. The order of rows and ties plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import WORD, discard, materialize, shingle_set
from pagelake.llm.components import connected, extended
from pagelake.llm.fingerprints import minima, word_hashes

WIDTH = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 4
MINIMA = 256
#: Estimates have a standard deviation of 0.028 here; five of them below the threshold are kept for the exact comparison.
SLACK = 0.14
#: A bucket's open pairs are listed if there are at most so many a member, or after so many stars.
PAIRS_A_MEMBER, STARS = 8, 3
NAMELESS = 1 << 62
PARTS = 32
INSIDE = "aggregate(zip_with(o_parts, parts, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"


def pack_bits(m: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a signed 64-bit word."""
    low = (m & np.uint32(15)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]
    return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def band_keys(m: np.ndarray) -> list[int]:
    blocks = m.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(blocks)]


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, nid, n_shingles, digest of the set, bands, bits of every row of docs (doc_id, text, nid)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes()
        for b in batches:
            out = []
            for doc_id, nid, text in zip(b.doc_id, b.nid, b.text):
                s = shingle_set(text if isinstance(text, str) else None, hashes, width)
                if len(s):
                    m = minima(s, MINIMA)
                    out.append((doc_id, nid, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(m[: BANDS * ROWS]), pack_bits(m).tolist()))
                else:
                    out.append((doc_id, nid, 0, b"", [], []))
            yield pd.DataFrame(out, columns=["doc_id", "nid", "n_shingles", "digest", "bands", "bits"]).astype({"doc_id": "Int64", "nid": "int64", "n_shingles": "int64"})

    return docs.mapInPandas(run, "doc_id long, nid long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def estimate(a: str, b: str) -> str:
    """Similarity from packed bits, corrected for chance collisions of four bits."""
    ones = "1229782938247303441"  # 0x1111...
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2) | shiftrightunsigned(x ^ y, 3)) & {ones}L)), 0, (s, x) -> s + x)"
    chance = 1 / (1 << BITS)
    return f"((1.0D - {differ} / {MINIMA}.0D) - {chance}D) / {1 - chance}D"


def confirm(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("node").alias("na"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("nb"), F.col("text").alias("tb"))
    both = pairs.join(right, F.col("b") == F.col("nb")).join(left, F.col("a") == F.col("na")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, kept = word_hashes(), {}
        for b in batches:
            ok = np.zeros(len(b), bool)
            for i, (x, ta, tb) in enumerate(zip(b.a, b.ta, b.tb)):
                if (x, len(ta)) not in kept:
                    if len(kept) > 50:
                        kept.clear()
                    kept[x, len(ta)] = (ta, shingle_set(ta, hashes, width))
                sa = kept[x, len(ta)][1] if kept[x, len(ta)][0] == ta else shingle_set(ta, hashes, width)
                sb = shingle_set(tb, hashes, width)
                inside = len(np.intersect1d(sa, sb, assume_unique=True))
                ok[i] = len(sa) > 0 and len(sb) > 0 and 100 * inside >= percent * (len(sa) + len(sb) - inside)
            yield b.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def _measured(nodes: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """mn, n, shared, parts, bits, marks of the nodes: the size of the set and how many of its shingles any other of these
    nodes has, in all and in each of ``PARTS`` parts of the hash space. A shingle of one node only is in no intersection, so
    the lesser count of two sets, part by part, bounds their intersection from above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes()
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                sets = [shingle_set(t, hashes, width).view(np.int64) for t in part.text]
                yield pd.DataFrame({"node": np.repeat(part.node.to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate(sets)})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes()
        for b in batches:
            parts = [np.bincount((shingle_set(t, hashes, width).view(np.int64) % PARTS), minlength=PARTS).tolist() for t in b.text]
            yield pd.DataFrame({"pn": b.node, "sizes": parts})

    some = texts.join(nodes.select(F.col("node").alias("wn")), F.col("node") == F.col("wn"), "left_semi")
    rows = some.mapInPandas(run, "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low = high")
    alone = alone.groupBy("low", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").alias("k"))
    alone = alone.groupBy("low").agg(F.sum("k").alias("alone"), F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("of"))
    sizes = classes.join(nodes.select(F.col("node").alias("wn")), F.col("node") == F.col("wn"), "left_semi").select(F.col("node").alias("mn"), "n", "bits", F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("marks"))
    whole = some.mapInPandas(split, "pn long, sizes array<long>").dropDuplicates(["pn"])
    both = sizes.join(whole, F.col("mn") == F.col("pn")).join(alone, F.col("mn") == F.col("low"), "left")
    parts = F.transform("sizes", lambda x, i: x - F.coalesce(F.try_element_at("of", i), F.lit(0)))
    return both.select("mn", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), F.when(F.col("of").isNull(), F.col("sizes")).otherwise(parts).alias("parts"), "bits", "marks")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    doc_id = F.col("doc_id").cast("long")
    # a row without an id is named by its text, above all ids in use, so that any real id comes before it
    docs = docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, NAMELESS + F.abs(F.xxhash64("text") / 4).cast("long")).alias("nid"))
    out = _components(docs, width, percent)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component") < NAMELESS, F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, nid, n_shingles, component of every row of docs (doc_id, text, nid); component is the least nid, null without words."""
    own = materialize(prints(docs, width), "near-prints")
    full = own.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("nid").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))
    classes = materialize(classes.select("node", "digest", "n", "bands", "bits"), "near-classes")
    members = classes.select("node", F.posexplode("bands").alias("place", "band")).withColumn("place", F.col("place") + 1)
    shared = materialize(members.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    member = materialize(members.join(shared.select(F.col("band").alias("of"), "lead"), F.col("band") == F.col("of")).select("band", "place", "node", "lead"), "near-members")
    bits = classes.select("node", "bits")
    wanted = member.select("node").distinct()
    texts = docs.filter("text is not null").join(wanted, F.col("nid") == F.col("node")).select("node", "text")
    texts = materialize(texts, "near-texts")

    def likely(pairs: DataFrame) -> DataFrame:
        """The candidate pairs but for those whose estimate is far below the threshold."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = bits.select(F.col("node").alias("xa"), F.col("bits").alias("xb")), bits.select(F.col("node").alias("ya"), F.col("bits").alias("yb"))
        both = pairs.join(y, F.col("b") == F.col("ya")).join(x, F.col("a") == F.col("xa"))
        return both.filter(F.expr(estimate("xb", "yb")) >= percent / 100 - SLACK).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "near-likely")
        found = materialize(confirm(pairs, texts, width, percent), "near-links")
        discard(pairs)
        return found

    links = confirmed(likely(member.select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    labels = connected(links)
    measured, done = None, None
    for star in range(1, STARS + 2):
        named = member.select("band", "place", "node").join(labels.select(F.col("node").alias("ln"), "component"), F.col("node") == F.col("ln"), "left").select("band", "place", "node", F.coalesce("component", "node").alias("component"))
        if done is not None:
            named = named.join(done, F.col("band") == F.col("done"), "left_anti")
        several = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select(F.col("band").alias("sb"))
        several = materialize(several, "near-several")  # joins get exchanges of their own, so that a hot band can be split
        named = materialize(named.join(several, F.col("band") == F.col("sb"), "left_semi"), "near-open")
        if named.isEmpty():
            break
        if measured is None:  # what is open only shrinks from here on
            measured = materialize(_measured(named.select("node").distinct(), texts, classes, width), "near-measured")
        rich = named.join(measured, F.col("node") == F.col("mn"))
        least = materialize(rich.groupBy("band").agg(F.min("n").alias("least_n")).select(F.col("band").alias("lb"), "least_n"), "near-least")
        # a member whose shared shingles cannot reach the threshold with even the bucket's smallest set has no link there
        able = rich.join(least, F.col("band") == F.col("lb")).filter(f"100 * shared >= {percent} * (n + greatest(least_n, shared) - shared)")
        able = materialize(able.select("band", "place", "node", "component", "n", "shared", "parts", "bits", "marks"), "near-able")
        per = able.groupBy("band", "component").agg(F.count("*").alias("k"), F.min("node").alias("least_node"))
        buckets = per.groupBy("band").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"), F.max_by("least_node", F.xxhash64("component", F.lit(star))).alias("other"))
        few = ((F.col("m") * F.col("m") - F.col("squares")) / 2 <= PAIRS_A_MEMBER * F.col("m")) | F.lit(star > STARS)
        buckets = materialize(buckets.filter("parts > 1").select(F.col("band").alias("of"), F.col("top.component").alias("main"), "other", few.alias("few")), "near-buckets")
        open_ = materialize(able.join(buckets, F.col("band") == F.col("of")), "near-pairing")
        outside = open_.filter("few and component <> main").select(*[F.col(c).alias("o_" + c) for c in ("band", "place", "node", "component", "n", "shared", "parts", "bits", "marks")])
        # each pair is compared at its first common band; the cheap exact bound comes first
        both = outside.join(open_.filter("few"), F.expr(
            "o_band = band and o_component <> component and (o_component < component or component = main) "
            f"and 100 * least(o_shared, shared) >= {percent} * (o_n + n - least(o_shared, shared)) "
            f"and 100 * {INSIDE} >= {percent} * (o_n + n - {INSIDE}) "
            "and array_position(zip_with(o_marks, marks, (x, y) -> x = y), true) = place "
            f"and {estimate('o_bits', 'bits')} >= {percent / 100 - SLACK}"
        ))
        listed = both.select(F.least("o_node", "node").alias("a"), F.greatest("o_node", "node").alias("b"))
        stars = open_.filter("not few").select(F.col("other").alias("a"), F.col("node").alias("b"))
        more = confirmed(listed.unionByName(likely(stars)).distinct())  # one pass over the texts a round
        discard(open_, able, least, several)
        now_done = buckets.filter("few").select(F.col("of").alias("done"))
        done = now_done if done is None else done.unionByName(now_done)
        if not more.isEmpty():
            labels = extended(labels, more)

    of_class = classes.select("digest", F.col("node")).join(labels.select(F.col("node").alias("ln"), "component"), F.col("node") == F.col("ln"), "left").select(F.col("digest").alias("cd"), F.coalesce("component", "node").alias("component"))
    of_class = materialize(of_class, "near-components")
    out = own.join(of_class, (F.col("digest") == F.col("cd")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "nid", "n_shingles", "component")


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, one of each component: the one with the least id, one without an id only where none has one.

    Rows of equal id and text count as one. Different texts that share an id are nodes of their own, as are texts without
    an id, named by a hash of both. Rows with neither an id nor a word are linked with nothing and all stay."""
    doc_id = F.col("doc_id").cast("long")
    wordless = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(WORD)
    h = F.xxhash64("text")
    shared = docs.filter("doc_id is not null").groupBy(doc_id.alias("__near_shared")).agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi")
    shared = materialize(shared.select("__near_shared"), "near-shared")
    named = docs.filter(~wordless).join(shared, doc_id == F.col("__near_shared"), "left")
    alone = F.col("doc_id").isNotNull() & F.col("__near_shared").isNull()
    named = named.withColumn("__near_key", F.when(alone, doc_id).otherwise(NAMELESS + F.shiftrightunsigned(F.xxhash64(doc_id, "text"), 2))).drop("__near_shared")
    nodes = _components(named.select(doc_id.alias("doc_id"), "text", F.col("__near_key").alias("nid")), width, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "nid")
    first = nodes.groupBy(F.coalesce("component", "nid")).agg(F.min_by("nid", order).alias("__near_id")).select("__near_id")
    verdict = materialize(first, "near-kept")
    kept = named.join(verdict, F.col("__near_key") == F.col("__near_id"), "left_semi").dropDuplicates(["__near_key"]).drop("__near_key")
    return kept.unionByName(docs.filter(wordless))
