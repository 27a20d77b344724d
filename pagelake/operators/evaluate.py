"""Aggregates that judge readings, views, turns and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.alignment import normalised_distance

PAGE = ["document_id", "page_number"]
# The temperature of the turn's classifier, its priors and the confidence that a turn needs.
TEMPERATURE, UPRIGHT, UPSIDE_DOWN, SURE_TURN = 0.6756, 0.979, 0.0008, 0.9


def _counts(frame: DataFrame, keys: list[str], n: str) -> DataFrame:
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9%$]+"), F.lit(0))).alias("token")
    return frame.select(*keys, token).groupBy(*keys, "token").agg(F.count("*").alias(n))


def token_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, dropped, added: the tokens that one side has more often, as multisets."""
    both = _counts(before, keys, "a").join(_counts(after, keys, "b"), [*keys, "token"], "full").fillna(0, ["a", "b"])
    return both.filter("a <> b").select(*keys, "token", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("dropped"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


def selected_view(baseline: DataFrame, enhanced: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, confidence) twice: the enhanced view stands if it keeps 0.98 of the tokens, adds two or more, grows by a quarter at
    most and is as sure but for 0.01. A key without baseline tokens keeps the baseline."""
    tokens = _counts(baseline, keys, "a").join(_counts(enhanced, keys, "b"), [*keys, "token"], "full").fillna(0, ["a", "b"])
    t = tokens.groupBy(*keys).agg(F.sum("a").alias("base"), F.sum("b").alias("enh"), F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"))
    mean = lambda d, n: d.groupBy(*keys).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias(n))
    out = mean(baseline, "ca").join(mean(enhanced, "cb"), keys, "left").join(t, keys, "left").fillna(0, ["base", "enh", "kept", "added"]).fillna(0.0, ["cb"])
    good = (F.col("base") > 0) & (F.col("kept") >= 0.98 * F.col("base")) & (F.col("added") >= 2) & (F.col("enh") <= 1.25 * F.col("base")) & (F.col("cb") >= F.col("ca") - 0.01)
    return out.select(*keys, F.when(good, "enhanced").otherwise("baseline").alias("view"), F.when(good, "recovered").otherwise("uncertain").alias("status"), "base", "enh", "added")


def consensus(readings: DataFrame, key: str) -> DataFrame:
    """(key, reader, text): each reader's mean disagreement with the key's other readers; keys with one reader give none. Texts are
    compared once for all readers who share them: a key's pairs are those of its distinct texts, and a reader's own are taken off."""
    r = readings.filter("reader is not null").select(F.col(key).alias("key"), "reader", "text")
    several = r.groupBy("key").agg(F.min("reader").alias("x"), F.max("reader").alias("y")).filter("x <> y").select("key")
    r = r.join(several, "key", "left_semi").groupBy("key", "reader", "text").agg(F.count("*").alias("n"))

    def compared(rows, keys):
        """Of each text among the rows of the same keys: summed distances and their number."""
        a, b = rows.select(*keys, "text"), rows.select(*keys, F.col("text").alias("other"), F.col("n").alias("m"))
        d = a.join(b, keys).withColumn("d", normalised_distance(F.col("text"), F.col("other")))
        return d.groupBy(*keys, "text").agg(F.sum(F.col("d") * F.col("m")).alias("s"), F.sum(F.when(F.col("d").isNotNull(), F.col("m"))).alias("c"))

    known = r.filter("text is not null")
    all_ = compared(known.groupBy("key", "text").agg(F.sum("n").alias("n")), ["key"])
    own = compared(known, ["key", "reader"]).withColumnsRenamed({"s": "own_s", "c": "own_c"})
    each = r.join(all_, ["key", "text"], "left").join(own, ["key", "reader", "text"], "left")
    total = lambda c: F.sum(F.col("n") * (F.coalesce(c, F.lit(0)) - F.coalesce("own_" + c, F.lit(0))))
    mean = F.round(F.try_divide(total("s"), total("c")), 6)
    return each.groupBy(F.col("key").alias(key), "reader").agg(mean.alias("disagreement"))


def page_turn(votes: DataFrame) -> DataFrame:
    """votes (keys, view 0..3, probabilities array of 4): each view's vote in the page's frame, mean logarithm over the temperature
    plus the prior, softmax; a turn less sure than 0.9 is none."""
    sideways = (1 - UPRIGHT - UPSIDE_DOWN) / 2
    prior = F.array(*[F.lit(float(x)) for x in (UPRIGHT, sideways, UPSIDE_DOWN, sideways)])
    each = votes.select(*PAGE, "view", F.posexplode("probabilities").alias("k", "p")).withColumn("turn", F.pmod(F.col("k") - F.col("view"), F.lit(4)))
    score = each.groupBy(*PAGE, "turn").agg((F.avg(F.log(F.greatest("p", F.lit(1e-12)))) / TEMPERATURE).alias("s")).withColumn("s", F.col("s") + F.log(F.get(prior, F.col("turn"))))
    post = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(Window.partitionBy(*PAGE)))).withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy(*PAGE)))
    top = post.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("p"), "turn"))).filter("r = 1")
    return top.select(*PAGE, F.when(F.col("p") < SURE_TURN, 0).otherwise(F.col("turn")).alias("turn"), F.round("p", 6).alias("posterior"))


def page_uncertainty(regions: DataFrame) -> DataFrame:
    """Mean confidence, regions unresolved and conflicting, and the distinct reasons in order of appearance."""
    r = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "reasons")))
    return regions.groupBy(*PAGE).agg(
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("resolution") == "unreadable").alias("unreadable"), F.count_if(F.col("resolution") == "conflicting").alias("conflicting"),
        F.array_distinct(F.flatten(F.transform(r, lambda x: F.coalesce(x["reasons"], F.array().cast("array<string>"))))).alias("reasons"),
    )


def ocr_confidence(values: DataFrame, cited: DataFrame) -> DataFrame:
    """values (value_id, raw), cited regions (value_id, text, score): the best score of the regions that hold the value whole; else the
    least of those that share a word with it, or of all; null if one of these has no score."""
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    v = values.select("value_id", key(F.col("raw")).alias("k"), words(F.col("raw")).alias("w"))
    rows = v.join(cited, "value_id", "left")
    rows = rows.withColumn("whole", (F.col("k") != "") & F.contains(key(F.col("text")), F.col("k"))).withColumn("shares", F.arrays_overlap("w", words(F.col("text"))))
    out = rows.groupBy("value_id").agg(
        F.max(F.when(F.col("whole"), F.col("score"))).alias("best"), F.max("shares").alias("any"),
        F.min(F.when(F.col("shares"), F.col("score"))).alias("held"), F.count_if(F.col("shares") & F.col("score").isNull()).alias("held_null"),
        F.min("score").alias("all"), F.count_if(F.col("score").isNull()).alias("all_null"),
    )
    rest = F.when(F.col("any"), F.when(F.col("held_null") == 0, F.col("held"))).otherwise(F.when(F.col("all_null") == 0, F.col("all")))
    return out.select("value_id", F.round(F.coalesce("best", rest), 4).alias("confidence"))


def cell_scores(cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """cells (table_id, cell_id, start, end), tokens (table_id, start, end, score): the geometric mean over the tokens that overlap."""
    c, t = cells.alias("c"), tokens.alias("t")
    on = (F.col("c.table_id") == F.col("t.table_id")) & (F.col("t.start") < F.col("c.end")) & (F.col("t.end") > F.col("c.start"))
    return c.join(t, on).groupBy("c.table_id", "c.cell_id").agg(F.round(F.exp(F.avg(F.log(F.greatest("t.score", F.lit(1e-30))))), 6).alias("score"), F.count("*").alias("tokens"))


def foreign_scripts(regions: DataFrame) -> DataFrame:
    """regions with scripts (map of letters), from_pdf, resolution: those with a script that isn't the page's main one become
    conflicting; read from a PDF or unreadable, they stay. Ties of the main script go to the one seen first."""
    each = regions.filter("kind <> 'formula'").select(*PAGE, "region_id", "reading_order", F.posexplode("scripts").alias("at", "script", "n"))
    per = each.groupBy(*PAGE, "script").agg(F.sum("n").alias("n"), F.min(F.struct("reading_order", "region_id", "at")).alias("first"))
    main = per.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "first"))).filter("r = 1").select(*PAGE, F.col("script").alias("main"))
    other = each.join(main, PAGE).filter("script <> main").groupBy(*PAGE, "region_id").agg(F.array_sort(F.collect_set("script")).alias("foreign"))
    out = regions.join(other, [*PAGE, "region_id"], "left")
    flag = F.col("foreign").isNotNull() & ~F.coalesce("from_pdf", F.lit(False)) & (F.col("resolution") != "unreadable")
    return out.withColumn("resolution", F.when(flag, "conflicting").otherwise(F.col("resolution"))).withColumn("foreign", F.when(flag, F.col("foreign")))


def greedy_tables(scores: DataFrame) -> DataFrame:
    """scores (group, target, candidate, score): targets in order each take the best candidate that none took; ties to the least one.
    One group is a document's tables."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for target, part in g.sort_values(["target", "score", "candidate"], ascending=[True, False, True]).groupby("target"):
            free = part[~part.candidate.isin(used)]
            if len(free):
                used.add(free.candidate.iloc[0])
                rows.append((g["group"].iloc[0], target, free.candidate.iloc[0], free.score.iloc[0]))
        return pd.DataFrame(rows, columns=["group", "target", "candidate", "score"])

    return scores.select("group", "target", "candidate", "score").groupBy("group").applyInPandas(run, scores.select("group", "target", "candidate", "score").schema)


def case_summary(events: DataFrame) -> DataFrame:
    """events (case_id, ts, action): first touch, minutes from the first event to the submission, number of reviewer actions."""
    seen = F.col("action").isin("edit", "approve", "reject", "add")
    done = F.max(F.when(F.col("action") == "submit", F.col("ts")))
    minutes = F.round((done.cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")) / 60, 2)
    return events.groupBy("case_id").agg(F.min(F.when(seen, F.col("ts"))).alias("first_review"), minutes.alias("minutes"), F.count_if(seen).alias("touches"))


def merged_groups(values: DataFrame, by: list[str]) -> DataFrame:
    """values (case_id, *by, value, position): one row for each value by letters and digits, numbered by first appearance."""
    norm = values.withColumn("norm", F.lower(F.regexp_replace("value", "[^A-Za-z0-9]", "")))
    one = norm.groupBy("case_id", *by, "norm").agg(F.min_by("value", "position").alias("value"), F.min("position").alias("seen"), F.count("*").alias("readings"))
    return one.withColumn("number", F.row_number().over(Window.partitionBy("case_id", *by).orderBy("seen"))).drop("norm", "seen")
