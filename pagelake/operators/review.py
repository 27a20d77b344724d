"""Review of regions and cases: risk rows, patches, corrections, crops and their answers, carry-over, sampling and submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.operators.consolidate import merged_values, missing_required, routed

PAGE = ["document_id", "page_number"]
# Share of the audit sample in thousandths, values from which one is drawn at least; crops a request holds.
AUDIT_SHARE, AUDIT_LEAST, CROPS = 30, 10, 12
VISUAL = ("image", "figure", "signature", "handwriting")
DOUBTS = ("sampled_retry_read", "likely_misread_text", "second_reader_doubt", "letter_among_digits")


def with_risk_rows(regions: DataFrame, kind: str = "coverage_risk") -> DataFrame:
    """regions with reasons: one row more on each page that has any; its id gets a suffix if taken, its order is the last."""
    every = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "reasons")))
    risky = regions.groupBy(*PAGE).agg(
        (F.max("reading_order") + 1).alias("reading_order"), F.array_distinct(F.flatten(F.transform(every, lambda x: F.coalesce(x["reasons"], F.array().cast("array<string>"))))).alias("reasons"),
        F.transform(F.filter(every, lambda x: F.size(x["reasons"]) > 0), lambda x: x["region_id"]).alias("source_ids"), F.collect_set("region_id").alias("ids"),
    ).filter("size(reasons) > 0")
    name = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-runtime-risk"))
    free = F.filter(F.concat(F.array(name), F.transform(F.sequence(F.lit(2), F.size("ids") + 2), lambda i: F.concat(name, F.lit("-"), i.cast("string")))), lambda n: ~F.array_contains("ids", n))
    return regions.unionByName(risky.select(*PAGE, F.get(free, 0).alias("region_id"), F.lit(kind).alias("kind"), "reading_order", "reasons", "source_ids"), allowMissingColumns=True)


def patch_outcomes(patches: DataFrame, authorised: DataFrame, regions: DataFrame) -> DataFrame:
    """patches (document_id, region_id, text, kind?): each with the reason why it is refused; null where it is applied."""
    p = patches if "kind" in patches.columns else patches.withColumn("kind", F.lit(None).cast("string"))
    n = p.groupBy("document_id", "region_id").agg(F.count("*").alias("times"))
    a = authorised.select("document_id", "region_id").distinct().withColumn("allowed", F.lit(True))
    r = regions.select("document_id", "region_id", F.col("kind").alias("old_kind"))
    out = p.join(n, ["document_id", "region_id"]).join(a, ["document_id", "region_id"], "left").join(r, ["document_id", "region_id"], "left")
    why = F.when(F.col("old_kind").isNull(), "unknown region").when(F.col("allowed").isNull(), "not authorised").when(F.col("times") > 1, "patched twice").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text").when(F.col("kind").isNotNull() & (F.col("kind") != F.col("old_kind")), "protected field")
    return out.select("document_id", "region_id", "text", why.alias("refused"))


def patched(regions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Regions after the patches; a document with a refused patch stays as it was."""
    bad = outcomes.filter("refused is not null").select("document_id").distinct()
    good = outcomes.join(bad, "document_id", "left_anti").select("document_id", "region_id", F.col("text").alias("_new"))
    return regions.join(good, ["document_id", "region_id"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def corrections(regions: DataFrame, events: DataFrame) -> DataFrame:
    """events (document_id, base_revision, position, action, region_id, text). Events of a document count while each names the revision it
    was made on, the first of one revision winning; the last that counts decides a region. Returns regions with text, review and revision."""
    w = Window.partitionBy("document_id", "base_revision").orderBy("position")
    one = events.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    run = Window.partitionBy("document_id").orderBy("base_revision")
    valid = one.withColumn("_k", F.row_number().over(run)).filter("base_revision = _k")  # revisions start at 1 without holes
    last = valid.groupBy("document_id", "region_id").agg(F.max_by("action", "base_revision").alias("review"), F.max_by(F.when(F.col("action").isin("edit", "accept"), F.col("text")), F.when(F.col("action").isin("edit", "accept"), F.col("base_revision"))).alias("_text"))
    revision = valid.groupBy("document_id").agg((F.max("base_revision") + 1).alias("revision"))
    out = regions.join(last, ["document_id", "region_id"], "left").join(revision, "document_id", "left")
    return out.withColumn("original", F.when(F.col("_text").isNotNull(), F.col("text"))).withColumn("text", F.coalesce("_text", "text")).withColumn("revision", F.coalesce("revision", F.lit(1))).drop("_text")


def stale(events: DataFrame) -> DataFrame:
    """Events refused because another one had changed their base revision before, or because no such revision came to be."""
    w = Window.partitionBy("document_id", "base_revision").orderBy("position")
    first = events.withColumn("_r", F.row_number().over(w))
    k = first.filter("_r = 1").withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy("base_revision"))).select("document_id", "base_revision", "_k")
    return first.join(k, ["document_id", "base_revision"]).filter("_r > 1 or _k <> base_revision").drop("_r", "_k")


def crop_groups(regions: DataFrame) -> DataFrame:
    """regions (kind, resolution, reasons, share, text, bad_cells, has_control): crops with their reasons, numbered in reading order and by
    request. Large regions with nothing but doubts are held back; forms need a control."""
    none = F.array().cast("array<string>")
    more = F.array_compact(F.array(F.when(F.col("kind").isin(*VISUAL), "visual_region"), F.when(F.col("resolution") != "resolved", "unresolved_recognition"), F.when(F.coalesce("bad_cells", F.lit(0)) > 0, "table_cells_unresolved")))
    r = regions.withColumn("why", F.array_distinct(F.concat(F.coalesce("reasons", none), more))).filter("size(why) > 0")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    doubts = F.size(F.array_except("why", F.array(*map(F.lit, DOUBTS)))) == 0
    held = doubts & (F.col("kind") != "table") & (F.col("resolution") == "resolved") & ((F.col("share") > 0.15) | (lines > 8))
    sent = r.filter(~F.coalesce(held, F.lit(False)) & ((F.col("kind") != "form_source") | F.coalesce("has_control", F.lit(False))))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("reading_order", "region_id"))
    return sent.select(*PAGE, n.alias("crop_id"), "region_id", F.array_join("why", ",").alias("reasons")).withColumn("request", F.floor((F.col("crop_id") - 1) / CROPS).cast("int"))


def crop_outcomes(crops: DataFrame, answers: DataFrame) -> DataFrame:
    """crops (page, crop_id, kind, reasons array, text), answers (page, crop_id, markdown): accepted, superseded text, error. A crop is
    answered exactly once; a blank answer to nothing but doubts makes a figure; figures get a pending alternative."""
    a = answers.groupBy(*PAGE, "crop_id").agg(F.count("*").alias("n"), F.min("markdown").alias("answer"))
    out = crops.join(a, [*PAGE, "crop_id"], "left")
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    doubts = F.size(F.array_except("reasons", F.array(*map(F.lit, DOUBTS)))) == 0
    error = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "answered twice").when(blank & ~doubts, "blank")
    took = F.when(error.isNotNull(), "none").when(blank, "reclassified").when(F.col("kind") == "figure", "pending").otherwise("replaced")
    new = F.when(took == "replaced", F.col("answer")).otherwise(F.col("text"))
    return out.select(*PAGE, "crop_id", took.alias("outcome"), error.alias("error"), F.when(took == "reclassified", "figure").otherwise(F.col("kind")).alias("kind"), F.when(took == "reclassified", "").otherwise(new).alias("text"), F.when(took.isin("replaced", "reclassified"), F.col("text")).alias("superseded"))


def refinement_status(outcomes: DataFrame) -> DataFrame:
    """generated without errors, partial if anything changed, else invalid."""
    changed = F.count_if(F.col("outcome") != "none") > 0
    return outcomes.groupBy(*PAGE).agg(F.when(F.count("error") == 0, "generated").when(changed, "partial").otherwise("invalid").alias("status"), F.count("error").alias("errors"))


def carried_over(values: DataFrame, previous: DataFrame) -> DataFrame:
    """A reviewer's edit or rejection of the earlier values stands after a new consolidation."""
    kept = previous.filter(F.col("state").isin("edited", "rejected")).select("case_id", "key", F.col("value").alias("_v"), F.col("state").alias("_s"))
    out = values.join(kept, ["case_id", "key"], "left")
    return out.withColumn("value", F.when(F.col("_s").isNotNull(), F.col("_v")).otherwise(F.col("value"))).withColumn("state", F.coalesce("_s", F.lit("pending"))).drop("_v", "_s")


def audit_sample(values: DataFrame, seed: int = 0) -> DataFrame:
    """3 % of each case's pending quick_verify values that are no defaults, at least one from ten on. The draw is a hash of the ids (the
    engine's own rule: reruns agree)."""
    open_ = (F.col("route") == "quick_verify") & (F.col("state") == "pending") & (F.col("source") != "default")
    draw = F.pmod(F.xxhash64("case_id", "value_id", F.lit(seed)), F.lit(1000))
    w = Window.partitionBy("case_id")
    v = values.withColumn("_d", F.when(open_, draw)).withColumn("_n", F.count("_d").over(w))
    v = v.withColumn("_r", F.row_number().over(w.orderBy(F.asc_nulls_last("_d"), "value_id")))
    return v.withColumn("audit_sample", F.coalesce((F.col("_d") < AUDIT_SHARE) | ((F.col("_n") >= AUDIT_LEAST) & (F.col("_r") == 1) & F.col("_d").isNotNull()), F.lit(False))).drop("_d", "_n", "_r")


def seeded_sample(rows: DataFrame, key: str, per: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each split without replacement, by a hash of key and seed."""
    w = Window.partitionBy(*per).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def blocking(values: DataFrame, exceptions: DataFrame) -> DataFrame:
    """case_id, blocking values, open errors, ready: a case goes out when neither is left."""
    v = values.groupBy("case_id").agg(F.count_if((F.col("route") == "priority_review") & (F.col("state") == "pending")).alias("blocking"), F.count_if(~F.col("valid")).alias("invalid"))
    e = exceptions.groupBy("case_id").agg(F.count_if((F.col("severity") == "error") & ~F.col("resolved")).alias("errors"))
    out = v.join(e, "case_id", "full").fillna(0, ["blocking", "invalid", "errors"])
    return out.withColumn("ready", (F.col("blocking") == 0) & (F.col("invalid") == 0) & (F.col("errors") == 0))


def expected_documents(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """cases (case_id, kind, types array), rules (kind, any_of array): the rules that none of a case's documents meets."""
    return cases.join(F.broadcast(rules), "kind").filter(~F.arrays_overlap("types", "any_of")).select("case_id", F.array_join("any_of", " or ").alias("missing"))  # rules are a fixed short list


def unenrolled(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Practitioner cases (case_id, npi, tin) whose group is known by neither; without both ids there is nothing to check. Two equi joins
    stand for the OR."""
    asked = cases.filter("kind = 'practitioner' and (npi is not null or tin is not null)")
    return asked.join(groups.select("npi").distinct(), "npi", "left_anti").join(groups.select("tin").distinct(), "tin", "left_anti")


def consolidated(readings: DataFrame, catalog: DataFrame, limits: DataFrame, previous: DataFrame) -> DataFrame:
    """A case from end to end: merge, stubs for required keys, routes by threshold, what reviewers said before."""
    merged = merged_values(readings).withColumn("source", F.lit("reading"))
    stubs = missing_required(catalog, readings).select("case_id", "key", F.col("default").alias("value"), F.when(F.col("default").isNotNull(), "default").otherwise("missing").alias("source"), F.when(F.col("default").isNull(), "required value missing").alias("problem"))
    every = routed(merged.unionByName(stubs, allowMissingColumns=True), limits)
    route = F.when(F.col("source") == "default", "default").when(F.col("source") == "missing", "exception").otherwise(F.col("route"))
    return carried_over(every.withColumn("route", route), previous)
