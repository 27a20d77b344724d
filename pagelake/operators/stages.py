"""Stages over regions with a record of what each did, and the arrangement of a page from suppression to order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import regions as R
from pagelake.operators import layout, matching

PAGE = ["document_id", "page_number"]
KEY = [*PAGE, "region_id"]


def stage_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per page how many regions a stage added, removed and modified; columns that only one side has aren't compared."""
    shared = sorted(set(before.columns) & set(after.columns) - set(KEY))
    state = lambda d, n: d.select(*KEY, F.xxhash64(F.to_json(F.struct(*shared), {"ignoreNullFields": "false"})).alias(n))
    both = state(before, "a").join(state(after, "b"), KEY, "full")
    count = lambda c, n: F.count_if(c).alias(n)
    return both.groupBy(*PAGE).agg(count(F.col("a").isNull(), "added"), count(F.col("b").isNull(), "removed"), count(F.col("a") != F.col("b"), "modified"))


def run_stages(regions: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(regions, executions, failures). A stage whose plan fails leaves the regions as they were and is named with its error; the others
    leave a row a page in the executions. Nothing runs here: a failure while rows are computed is the job's."""
    executions, failures = None, []
    for name, stage in stages:
        try:
            after = stage(regions)
            rows = stage_changes(regions, after).withColumn("stage", F.lit(name))
        except (PySparkException, ValueError, KeyError) as error:
            failures.append((name, type(error).__name__))
            continue
        executions = rows if executions is None else executions.unionByName(rows)
        regions = after
    return regions, executions, failures


def arranged(regions: DataFrame) -> DataFrame:
    """regions: kind, role, text, resolution, confidence, reading_order, child_ids, box. Suppressed rows go, specks and repeats go, the
    rest gets its rank by the banded order; a page with a row without a box keeps its reading order. Labels and values are not paired."""
    child = regions.select(*PAGE, F.col("region_id").alias("_p"), F.explode("child_ids").alias("region_id"))
    held = child.join(regions.select(*KEY), KEY, "left_semi").select(*PAGE, F.col("_p").alias("region_id")).distinct().withColumn("_kids", F.lit(True))
    c = F.col
    judged = regions.join(held, KEY, "left").withColumn("_why", R.suppression_reason(c("kind"), c("role"), c("text"), c("resolution"), F.lit(False), c("_kids")))
    shown = judged.filter("_why is null").filter(~R.junk_speck(c("kind"), c("resolution"), F.lit(""), c("confidence"), c("text"))).drop("_why", "_kids")
    boxed = shown.filter(c("left").isNotNull())
    shown = shown.join(matching.suppressed_repeats(boxed).select(*KEY), KEY, "left_anti")
    lacking = shown.filter(c("left").isNull()).select(*PAGE).distinct()
    ranked = layout.with_banded_order(shown.join(lacking, PAGE, "left_anti").select(*KEY, "left", "top", "right", "bottom")).select(*KEY, c("banded_rank").alias("rank"))
    plain = shown.join(lacking, PAGE, "left_semi").select(*KEY, F.row_number().over(Window.partitionBy(*PAGE).orderBy("reading_order", "region_id")).alias("rank"))
    return shown.join(ranked.unionByName(plain), KEY)


def owned(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """regions with the layout block (block_id, child_ids) that owns them; of several the least."""
    owner = blocks.select(*PAGE, "block_id", F.explode("child_ids").alias("region_id")).groupBy(*KEY).agg(F.min("block_id").alias("layout_owner_id"))
    return regions.join(owner, KEY, "left")


def citations(evidence: DataFrame) -> DataFrame:
    """evidence (value_id, page, box): the hull of a value's evidence on each page."""
    return evidence.groupBy("value_id", *PAGE).agg(*[(F.min if s in ("left", "top") else F.max)(s).alias(s) for s in ("left", "top", "right", "bottom")])
