"""Mixing sources to target weights by subset-sum budget fitting.

A source's target words come from its weight. Each document can be taken up to twice; the budget is fitted over the
histogram of exact document sizes: a proportional share of every size first, then a bounded knapsack for the rest. The
copies of a size go to all its documents alike, and what is left over to some by a seeded hash, so reruns agree.

Cases: null text has size 0 and takes 0; a null source is a source of its own, last; repeated rows are
separate documents; a source without words has target 0; an empty table gives no rows; extra columns
stay out of the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import WORD, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: The knapsack fits the last so many words exactly, or twice the longest document if that is more.
KNAPSACK = 1 << 15
#: A size's documents are chosen by hash bucket; with more documents than these hold there are more buckets.
BUCKETS, PER_BUCKET = 1024, 1 << 18


def water_fill(sizes: list[float], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Share the budget by weight; a source stops at ``most`` times its size and the excess is shared anew."""
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK) -> np.ndarray:
    """How many documents of each size to take so that their words come to the budget, or as near below it as
    the knapsack over the last ``window`` words can come. sizes: distinct, positive."""
    sizes, counts = [int(x) for x in sizes], [int(x) for x in counts]
    window = max(window, 2 * max(sizes, default=0))  # so that very long documents take part in it
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return np.array(counts, np.int64)
    take = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:  # large sizes bring the rest of the budget into the knapsack's window
        if left <= window:
            break
        k = min(counts[i] - take[i], (left - window // 2) // sizes[i])
        take[i] += k
        left -= k * sizes[i]
    if left > window:  # only sizes beyond the window are left
        for i in order:
            k = min(counts[i] - take[i], left // sizes[i])
            take[i] += k
            left -= k * sizes[i]
    for i in order:  # a small rest gives the knapsack little choice: hand shares back while its window holds them
        k = min(take[i], (window - left) // sizes[i]) if left <= window else 0
        take[i] -= max(0, k)
        left += max(0, k) * sizes[i]
    left = max(0, min(left, window))
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        free = min(counts[i] - take[i], left // sizes[i])
        unit = 1
        while free > 0 and not reach >> left & 1:
            k = min(unit, free)
            steps.append((i, k, reach))
            reach |= reach << (k * sizes[i]) & mask
            free -= k
            unit *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * sizes[i]
    return np.array(take, np.int64)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    Only per-source totals reach the driver. The size histogram is counted before it is shuffled by source;
    documents are matched to decisions by (source, size, hash bucket), so a hot source or size is spread.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    light = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("skey"),
        size.alias("size"),
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"),
    )
    light = materialize(light, "mix-sizes")
    light = light.withColumn("hb", F.pmod("h", F.lit(max(BUCKETS, light.count() // PER_BUCKET))).cast("int"))
    hist = light.groupBy("skey", "size", "hb").agg(F.count("*").alias("n"))
    hist = materialize(hist, "mix-histogram")
    totals = [(r[0], int(r[1])) for r in hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    totals.sort(key=lambda x: (x[0] == "n", x[0].encode()))
    words = [t for _, t in totals]
    targets = water_fill(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), most)
    plan_of = {k: (t, s) for (k, s), t in zip(totals, targets)}

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        target, total = plan_of[rows.skey.iloc[0]]
        some = rows[rows["size"] > 0]
        n = some.n.to_numpy()
        copies = fit_budget(some["size"].to_numpy(), most * n, int(round(target))) if len(some) else n
        take = pd.DataFrame({"k": 0, "passes": 0}, index=rows.index, dtype="int64")
        take.loc[some.index, "k"], take.loc[some.index, "passes"] = copies % n, copies // n
        return pd.DataFrame({"skey": rows.skey, "size": rows["size"], "k": take.k, "passes": take.passes.astype("int32"), "target": target, "source_size": total})

    decided = (
        hist.groupBy("skey", "size").agg(F.sum("n").alias("n"))
        .groupBy("skey").applyInPandas(decide, "skey string, size long, k long, passes int, target double, source_size long")
    )
    run = Window.partitionBy("skey", "size").orderBy("hb").rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = (
        hist.join(decided, ["skey", "size"])
        .withColumn("upto", F.sum("n").over(run))
        .select("skey", "size", "hb", "passes", "target", "source_size", F.greatest(F.lit(0), F.least("n", F.expr("k - (upto - n)"))).alias("picks"))
    )
    per_bucket = materialize(per_bucket, "mix-decisions")
    rank = Window.partitionBy("skey", "size", "hb").orderBy("h")
    return (
        light.withColumn("r", F.row_number().over(rank))
        .join(per_bucket, ["skey", "size", "hb"])
        .withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") + (F.col("r") <= F.col("picks")).cast("int")))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of docs, each row as often as the mix takes it. Rows equal in every column share
    their copies as evenly as whole numbers allow."""
    names = docs.columns
    keyed = docs.withColumn("__mix_key", F.concat_ws(":", F.xxhash64(F.struct(*names)), F.xxhash64(F.lit(SEED), F.struct(*names))))
    copies = mix_sources(keyed.select(F.col("__mix_key").alias("doc_id"), "text", "source"), **options)
    copies = copies.groupBy("doc_id").agg(F.sum("copies").alias("__mix_n"), F.count("*").alias("__mix_rows")).filter("__mix_n > 0")
    copies = materialize(copies.withColumnRenamed("doc_id", "__mix_id"), "mix-copies")
    joined = keyed.join(copies, F.col("__mix_key") == F.col("__mix_id"))
    place = F.row_number().over(Window.partitionBy("__mix_key").orderBy("__mix_key"))
    share = joined.withColumn("__mix_i", place).withColumn("__mix_c", F.expr("cast(__mix_n div __mix_rows + if(__mix_i <= __mix_n % __mix_rows, 1, 0) as int)"))
    return share.filter("__mix_c > 0").withColumn("__mix_e", F.explode(F.expr("sequence(1, __mix_c)"))).select(*names)
