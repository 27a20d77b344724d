"""Counts, rates, runs and choices over records: usage, cases, readings, revisions and tables in order.

Every operator takes rows and the names of their columns, is one aggregation or window, and gives a DataFrame. Windows are
partitioned by a key and ordered by enough columns to be total, so ties do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import geometry as G


def _named(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# roll-ups
def usage_summary(usage: DataFrame, key: str, value: str, user: str) -> DataFrame:
    """Entries, total, mean and most of a value, and distinct users, of each key."""
    return usage.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.count_distinct(user).alias("users"))


def daily_volume(rows: DataFrame, at: str) -> DataFrame:
    """Rows a day, by the first ten characters of the time, without a shift of zone."""
    return rows.groupBy(F.substring(F.col(at).cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


def medians(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The interpolated median of a value by key and day."""
    return rows.groupBy(key, F.substring(F.col(at).cast("string"), 1, 10).alias("day")).agg(F.median(value).alias("middle"))


def counts_of(rows: DataFrame, key: str, column: str, names: dict[str, str]) -> DataFrame:
    """A column a value of interest with its count, 0 where a key has none."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(n) for n, v in names.items()])


def histogram(rows: DataFrame, value: str, bins: int = 10, scale: float = 10) -> DataFrame:
    """Rows in each of the bins of value * scale, the last one open, zero-filled."""
    found = rows.filter(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * scale)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(rows: DataFrame, key: str, right: str, flagged: str) -> DataFrame:
    """Labels, the share that is right, and how many are flagged, of each key; the share is null without labels."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("accuracy"), F.sum(flagged).alias(flagged))


def exception_rates(cases: DataFrame, key: str, failed: Column, touched: Column) -> DataFrame:
    """Cases, the share with an exception and those touched, of each key."""
    return cases.groupBy(key).agg(F.count("*").alias("cases"), F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("exception_rate"), F.count_if(touched).alias("touched"))


def combined_usage(requests: DataFrame, key: str, amount: str, provider: str) -> DataFrame:
    """The requests of a key as one: the amount is null if any is, the provider is named if there is but one."""
    whole = F.when(F.count(amount) == F.count("*"), F.sum(amount))
    one = F.when(F.count_distinct(provider) == 1, F.min(provider)).otherwise("multiple")
    return requests.groupBy(key).agg(whole.alias("spent"), one.alias("priority"), F.count("*").alias("n"))


def document_status(regions: DataFrame, key: str, failed: Column) -> DataFrame:
    """success without a failure, partial with some, failed if nothing else is there."""
    bad = F.count_if(failed)
    return regions.groupBy(key).agg(F.when(bad == 0, "success").when(bad < F.count("*"), "partial").otherwise("failed").alias("status"))


def page_route(regions: DataFrame, key: str, doubtful: Column) -> DataFrame:
    """review if any region is doubtful."""
    return regions.groupBy(key).agg(F.when(F.bool_or(F.coalesce(doubtful, F.lit(False))), "review").otherwise("accept_local").alias("route"))


# order
def latest(rows: DataFrame, key: str | list[str], by: list[str], k: int) -> DataFrame:
    """The k rows of each key that come last by the columns, with their place r from the last."""
    place = Window.partitionBy(*_named(key)).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k)


def chunks(rows: DataFrame, key: str, by: list[str], size: int = 12) -> DataFrame:
    """Rows of a key in pieces of a size, numbered from 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1) / size).cast("long"))


def boundary(rows: DataFrame, key: str, by: list[str], value: str, first: str, last: str) -> DataFrame:
    """The value of the first and of the last row of each key."""
    order = F.struct(*by)
    return rows.groupBy(key).agg(F.min_by(value, order).alias(first), F.max_by(value, order).alias(last))


def row_offsets(parts: DataFrame, key: str, by: list[str], size: str) -> DataFrame:
    """The sum of the sizes before each part of its key."""
    earlier = Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(size).over(earlier), F.lit(0.0)))


def chains(edges: DataFrame, key: str, by: list[str], link: str) -> DataFrame:
    """Runs of neighbours with the same link: their number in the key, the link and their length."""
    order = Window.partitionBy(key).orderBy(*by)
    fresh = edges.withColumn("_fresh", F.when(F.col(link) == F.lag(link).over(order), 0).otherwise(1))
    numbered = fresh.withColumn("chain", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "chain").agg(F.min(link).alias("status"), F.count("*").alias("n"))


def segments(rows: DataFrame, key: str, at: str, tie: str, gap: Column) -> DataFrame:
    """A segment number: a new one begins where more than the gap lies between neighbours."""
    order = Window.partitionBy(key).orderBy(at, tie)
    fresh = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("segment", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def islands(intervals: DataFrame, key: str, low: str, high: str, tie: str) -> DataFrame:
    """Intervals of a key that overlap or touch as one, numbered from the lowest, with their count."""
    order = Window.partitionBy(key).orderBy(low, tie)
    reached = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("_fresh", F.when(F.col(low) <= reached, 0).otherwise(1))
    numbered = fresh.withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n"))


def inversions(rows: DataFrame, key: str, given: str, by: list[str]) -> DataFrame:
    """Of two orders of a key's rows: pairs in opposite order and the first place of one; keys without a pair are left out."""
    ranked = rows.select(key, F.col(given).alias("i"), F.row_number().over(Window.partitionBy(key).orderBy(*by)).alias("r"))
    later = ranked.select(F.col(key).alias("k"), F.col("i").alias("j"), F.col("r").alias("s"))
    pairs = ranked.join(later, (F.col(key) == F.col("k")) & (F.col("i") < F.col("j")) & (F.col("r") > F.col("s")))
    return pairs.groupBy(key).agg(F.count("*").alias("inversions"), F.min("i").alias("first_at"))


def in_order(rows: DataFrame, key: str, by: str, text: Column, separator: str = "\n") -> DataFrame:
    """The texts of a key in order as one, and how many."""
    lines = rows.groupBy(key).agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct(F.col(by).alias("at"), text.alias("line")))).alias("ls"))
    return lines.select(key, "turns", F.array_join(F.transform("ls", lambda x: x["line"]), separator).alias("rendered"))


# choices
def best_match(pairs: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of each key with the highest score; ties to the least ``tie``."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).filter("_r = 1").drop("_r")


def paired_occurrences(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other: key, k, first, second."""
    numbered = lambda d, n: d.select(key, F.row_number().over(Window.partitionBy(key).orderBy(by)).alias("k"), F.col(by).alias(n))
    return numbered(a, "first").join(numbered(b, "second"), [key, "k"])


def latest_verdict(entries: DataFrame, feedback: DataFrame, key: str, verdict: str, by: list[str]) -> DataFrame:
    """Every entry with the last verdict of its key, null without one."""
    return entries.join(feedback.groupBy(key).agg(F.max_by(verdict, F.struct(*by)).alias("verdict")), key, "left")


def folded_initials(names: DataFrame, key: str, short: str, name: str) -> DataFrame:
    """A short form of a key joined to the only name that begins so."""
    one = names.groupBy(key, short).agg(F.min(name).alias("joined"), F.count_distinct(name).alias("_n")).filter("_n = 1")
    return names.join(one.select(key, short, "joined"), [key, short])


def fewer(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on both sides whose values after are a strict part of those before."""
    sets = lambda d, n: d.groupBy(key).agg(F.collect_set(value).alias(n))
    both = sets(before, "x").join(sets(after, "y"), key)
    return both.filter((F.size(F.array_except("y", "x")) == 0) & (F.size("y") < F.size("x"))).select(key)


def expiring(rows: DataFrame, until: str, as_of: Column, days: int = 90) -> DataFrame:
    """Rows that have expired by a day or will within so many days, with their state."""
    late = F.col(until) < as_of
    return rows.withColumn("state", F.when(late, "expired").otherwise("soon")).filter(F.col(until) < as_of + F.expr(f"INTERVAL {days} DAYS"))


def first_seen(files: DataFrame, key: str, content: str) -> DataFrame:
    """Files whose content was seen under a lesser key, with that key. Only hashes are shuffled."""
    hashed = files.select(key, F.sha2(content, 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min(key).alias("duplicate_of"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(first, "h").filter(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")


def hash_split(name: Column, parts: int = 10) -> Column:
    """val for names whose sha1, read as a number, is a multiple of ten; else train."""
    digit = lambda i: F.conv(F.substr(F.sha1(name), i, F.lit(1)), 16, 10).cast("int")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda a, i: (a * 16 + digit(i)) % parts)
    return F.when(rest == 0, "val").otherwise("train")


# boxes: rows with a page or group key, an id and left, top, right, bottom
def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    x, y = a.alias("x"), b.alias("y")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return x, y, on


def _two_of_equal(holders: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The two least keys of each box: whichever row looks, the least that is not itself is there."""
    place = F.row_number().over(Window.partitionBy(*keys, *G.SIDES).orderBy(key))
    return holders.select(*keys, key, *G.SIDES).withColumn("_r", place).filter("_r <= 2").drop("_r")


def _in_cell(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in [*keys, *G.CELLS]:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return on


def outside_others(rows: DataFrame, keys: list[str], key: str, holders: DataFrame | None = None) -> DataFrame:
    """Rows (of one key each) that no other box of their page holds whole. A row looks in the cell of its corner, on each level of the
    holders' sizes, and stops at the first that holds it."""
    h = _two_of_equal(rows if holders is None else holders, keys, key)
    x, y = G.at_levels(rows.select(*keys, key, *G.SIDES), G.box_levels(h, keys), keys, "left", "top").alias("x"), G.spread_boxes(h).alias("y")
    held = (F.col("y.left") <= F.col("x.left")) & (F.col("y.top") <= F.col("x.top")) & (F.col("y.right") >= F.col("x.right")) & (F.col("y.bottom") >= F.col("x.bottom"))
    gone = x.join(y.hint("merge"), _in_cell(keys) & held & (F.col(f"x.{key}") != F.col(f"y.{key}")), "left_semi").select(*keys, key).distinct()
    return rows.join(gone, [*keys, key], "left_anti").select(rows.columns)


def smallest_holder(rows: DataFrame, holders: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The smallest box of the page, not the row's own, that holds a row's centre: key, holder; ties to the least. Holders are numbered
    by size first, so that a row keeps one number of those in its centre's cells."""
    c = F.col
    area = (c("right") - c("left")) * (c("bottom") - c("top"))
    h = _two_of_equal(holders, keys, key).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(area, key)))
    centres = rows.select(*keys, key, ((c("left") + c("right")) / 2).alias("x"), ((c("top") + c("bottom")) / 2).alias("y"))
    x, y = G.at_levels(centres, G.box_levels(h, keys), keys).alias("x"), G.spread_boxes(h).alias("y")
    inside = c("x.x").between(c("y.left"), c("y.right")) & c("x.y").between(c("y.top"), c("y.bottom"))
    met = x.join(y.hint("merge"), _in_cell(keys) & inside & (c(f"x.{key}") != c(f"y.{key}")))
    least = met.groupBy(*[c(f"x.{k}") for k in (*keys, key)]).agg(F.min("_rank").alias("_rank"))
    return least.join(h.select(*keys, "_rank", c(key).alias("holder")), [*keys, "_rank"]).select(key, "holder")


def similar_boxes(rows: DataFrame, keys: list[str], key: str, least: float) -> DataFrame:
    """Pairs (a, b) of a page's boxes, a the lesser key, whose IoU is above ``least`` (at most 0.5), with it.

    Two such boxes share more than ``least`` of the longer side on each axis, so their centres are no further apart than half of both sides
    less that. The box of the lower level of widths stands in the cell of its centre, the other one in all cells that such centres may have."""
    c = F.col
    sized = rows.filter("right > left and bottom > top").select(*keys, key, *G.SIDES, (c("right") - c("left")).alias("_w"), (c("bottom") - c("top")).alias("_h"))
    sized = sized.withColumn("_lx", G.side_level(c("_w"))).withColumn("_ly", G.side_level(c("_h")))
    levels = sized.groupBy(*keys, "_lx", "_ly").agg(F.max("_w").alias("_mw"), F.max("_h").alias("_mh"), F.min("_w").alias("_nw"), F.min("_h").alias("_nh"))
    x, y = (c("left") + c("right")) / 2, (c("top") + c("bottom")) / 2
    centres = sized.select(*keys, "_lx", "_ly", G.level_cell(x, c("_lx")).alias("_gx"), G.level_cell(y, c("_ly")).alias("_gy"), key, *G.SIDES)
    wide = sized.withColumnRenamed("_lx", "_own").drop("_ly").join(levels, keys).filter((c("_lx") <= c("_own")) & (c("_mw") >= least * c("_w")) & (c("_mh") >= least * c("_h")) & (c("_w") >= least * c("_nw")) & (c("_h") >= least * c("_nh")))
    reach = lambda one, other: (c(one) + c(other)) / 2 - least * F.greatest(c(one), c(other))
    span = lambda at, by, level: F.explode(F.sequence(G.level_cell(at - by, level), G.level_cell(at + by, level)))
    spread = wide.withColumn("_gx", span(x, reach("_w", "_mw"), c("_lx"))).withColumn("_gy", span(y, reach("_h", "_mh"), c("_ly"))).select(*keys, *G.CELLS, key, *G.SIDES, "_own")
    p, q = centres.alias("p"), spread.alias("q")
    boxes = [tuple(c(f"{n}.{s}") for s in G.SIDES) for n in ("p", "q")]
    inside, sizes = G.intersection(*boxes), G.area(boxes[0]) + G.area(boxes[1])
    on = ((c("p._lx") < c("q._own")) | (c(f"p.{key}") < c(f"q.{key}"))) & (c(f"p.{key}") != c(f"q.{key}")) & (inside > least * (sizes - inside))
    for k in [*keys, *G.CELLS]:
        on = on & (c(f"p.{k}") == c(f"q.{k}"))
    return p.join(q.hint("merge"), on).select(*[c(f"p.{k}") for k in keys], F.least(f"p.{key}", f"q.{key}").alias("a"), F.greatest(f"p.{key}", f"q.{key}").alias("b"), (inside / (sizes - inside)).alias("iou"))


def nearest_above(rows: DataFrame, headings: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The lowest heading above a row that shares x with it: key, heading; ties to the least."""
    x, y, on = _pairs(rows, headings, keys)
    c = F.col
    over = (c("y.bottom") <= c("x.top")) & (c("y.left") < c("x.right")) & (c("x.left") < c("y.right"))
    met = x.join(y, on & over).select(c(f"x.{key}").alias(key), c(f"y.{key}").alias("h"), c("y.bottom").alias("b"))
    return met.groupBy(key).agg(F.min_by("h", F.struct(-c("b"), "h")).alias("heading"))
