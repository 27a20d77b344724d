"""Values of several documents made one case: grouping, conflict, confidence, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.confidence import noisy_or
from pagelake.functions.text import alnum_key

# The threshold a key starts from, the accuracy aimed at and the labels a key needs.
DEFAULT_THRESHOLD, TARGET, LEAST_LABELS = 0.80, 0.95, 20
#: Bins of confidence whose totals are summed before rows are ordered.
BINS = 4096


def merged_values(values: DataFrame) -> DataFrame:
    """values: case_id, key, document_id, position, value, confidence. Readings that agree in letters and digits are one group;
    the group of most documents, then highest confidence, then first seen, wins, the rest are alternatives."""
    group = values.withColumn("norm", alnum_key(F.col("value")))
    caps = (F.upper("value") == F.col("value")).cast("int")
    best = F.max_by("value", F.struct(F.length("norm"), -caps, F.coalesce("confidence", F.lit(-1.0)), -F.col("position")))
    groups = group.groupBy("case_id", "key", "norm").agg(
        best.alias("value"), F.count_distinct("document_id").alias("documents"), noisy_or(F.col("confidence")).alias("confidence"), F.max("confidence").alias("top"), F.min("position").alias("seen")
    )
    w = Window.partitionBy("case_id", "key").orderBy(F.desc("documents"), F.desc_nulls_last("top"), "seen")
    ranked = groups.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("case_id", "key")))
    others = ranked.filter("r > 1").groupBy("case_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("alternatives"))
    out = ranked.filter("r = 1").join(others, ["case_id", "key"], "left")
    return out.select("case_id", "key", "value", "confidence", "documents", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"), F.when(F.col("n") > 1, "documents disagree").alias("problem"))


def _prefixes(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows: keys, confidence, good, n. Adds share and seen of every prefix of a key by falling confidence. Totals of BINS bins of confidence
    are summed first, so a window orders the rows of one bin of one key, and the window over a key sees BINS + 1 rows at most."""
    place = F.least(F.greatest(F.col("confidence") * BINS, F.lit(0.0)), F.lit(float(BINS)))  # values beyond 0 to 1 and NaN fall into the end bins
    binned = rows.withColumn("_bin", F.floor(place))
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("good").alias("_g"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_bin", F.coalesce(F.sum("_g").over(above), F.lit(0)).alias("_g"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    x, y, on = binned.alias("x"), before.alias("y"), F.lit(True)
    for k in [*keys, "_bin"]:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    w = Window.partitionBy(*[F.col(f"x.{k}") for k in [*keys, "_bin"]]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("_n") + F.sum("n").over(w)
    return x.join(y, on).select("x.*", ((F.col("_g") + F.sum("good").over(w)) / seen).alias("share"), seen.alias("seen"))


def thresholds(feedback: DataFrame) -> DataFrame:
    """feedback: key, confidence, correct, position. A key's threshold is the confidence of the last prefix, by falling confidence,
    whose accuracy reaches the target; keys with few labels take the overall one."""
    rows = feedback.filter("confidence is not null and correct is not null").select("key", "confidence", "position", F.col("correct").cast("long").alias("good"), F.lit(1).cast("long").alias("n"))
    own = _prefixes(rows, ["key"], [F.desc("confidence"), "position"]).groupBy("key")
    own = own.agg(F.coalesce(F.max_by("confidence", F.when(F.col("share") >= TARGET, F.col("seen"))), F.lit(DEFAULT_THRESHOLD)).alias("threshold"), F.count("*").alias("labels"))
    # the overall curve takes equal confidences together
    curve = _prefixes(rows.groupBy("confidence").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), [], [F.desc("confidence")])
    overall = curve.agg(F.min(F.when(F.col("share") >= TARGET, F.col("confidence"))).alias("t"), F.sum("n").alias("all"))
    overall = overall.select(F.when(F.col("all") >= LEAST_LABELS, F.coalesce("t", F.lit(DEFAULT_THRESHOLD))).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("overall"))
    per = own.crossJoin(F.broadcast(overall))  # one row
    return per.select("key", F.when(F.col("labels") >= LEAST_LABELS, F.col("threshold")).otherwise(F.col("overall")).alias("threshold"), "labels")


def routed(values: DataFrame, limits: DataFrame) -> DataFrame:
    """values with reasons and route: exceptions stay, reasons go to priority_review, the rest to quick_verify."""
    both = values.join(limits.select("key", "threshold"), "key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    reasons = F.array_compact(F.array(F.when(F.col("confidence").isNull(), "not scored"), F.when(F.col("confidence") < F.col("threshold"), "low confidence"), F.col("problem")))
    return both.withColumn("reasons", reasons).withColumn("route", F.when(F.size("reasons") > 0, "priority_review").otherwise("quick_verify"))


def missing_required(catalog: DataFrame, values: DataFrame) -> DataFrame:
    """Required keys of every case that has none, with their defaults."""
    cases = values.select("case_id").distinct()
    need = cases.join(F.broadcast(catalog.filter("required")))  # a catalog is a fixed short list
    return need.join(values.select("case_id", "key").distinct(), ["case_id", "key"], "left_anti")


def current_state(events: DataFrame) -> DataFrame:
    """Events (case_id, value_id, revision, action, text): the latest of each value decides."""
    return events.groupBy("case_id", "value_id").agg(F.max("revision").alias("revision"), F.max_by("action", "revision").alias("action"), F.max_by("text", "revision").alias("text"))
