"""Sinks: documents as JSON, Markdown and benchmark items, case bundles, submissions, metrics as CSV, and what retention keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.regions import markdown_escaped

PAGE = ["document_id", "page_number"]


def _ordered(rows: str, order: list[str], *fields: str):
    return F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(rows)


def json_documents(regions: DataFrame, compact: bool = False) -> DataFrame:
    """document_id, doc: pages in order with their regions in order; ``compact`` leaves image bytes out."""
    r = regions.drop("image") if compact and "image" in regions.columns else regions
    fields = [c for c in r.columns if c not in PAGE]
    pages = r.groupBy(*PAGE).agg(_ordered("regions", ["reading_order", "region_id"], *fields))
    docs = pages.groupBy("document_id").agg(_ordered("pages", ["page_number"], "regions"))
    return docs.select("document_id", F.to_json(F.struct("document_id", "pages")).alias("doc"))


def markdown_documents(regions: DataFrame) -> DataFrame:
    """document_id, markdown: titles and headings marked, lists with dashes, tables and formulas as they are."""
    t = markdown_escaped(F.col("text"))
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), t)).when(F.col("kind") == "section-header", F.concat(F.lit("## "), t)).when(F.col("kind") == "list-item", F.concat(F.lit("- "), t)).when(F.col("kind").isin("table", "formula"), F.col("text")).otherwise(t)
    rows = regions.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("document_id", "page_number", "reading_order", "region_id", line.alias("line"))
    per = rows.groupBy("document_id").agg(_ordered("lines", ["page_number", "reading_order", "region_id"], "line"))
    return per.select("document_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("markdown"))


def case_bundles(values: DataFrame, exceptions: DataFrame, audit: DataFrame) -> DataFrame:
    """case_id, bundle: a case's values, exceptions and audit trail as one JSON document; empty lists where there are none."""
    nest = lambda d, name, order: d.groupBy("case_id").agg(_ordered(name, order, *[c for c in d.columns if c != "case_id"]))
    parts = {"values": nest(values, "values", ["key"]), "exceptions": nest(exceptions, "exceptions", ["code"]), "audit": nest(audit, "audit", ["ts"])}
    out = None
    for part in parts.values():
        out = part if out is None else out.join(part, "case_id", "full")
    none = [F.coalesce(F.col(n), F.array().cast(p.schema[n].dataType)).alias(n) for n, p in parts.items()]
    return out.select("case_id", *none).select("case_id", F.to_json(F.struct("case_id", *parts)).alias("bundle"))


def submissions(values: DataFrame, keys: list[str]) -> DataFrame:
    """case_id and one column for each key of the fixed list; keys without a value are null."""
    return values.groupBy("case_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def client_fields(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """case_id, section, fields: the catalog (key, section, default) laid out as maps; defaults fill what is missing."""
    need = values.select("case_id").distinct().join(F.broadcast(catalog))  # a catalog is a fixed short list
    filled = need.join(values.select("case_id", "key", "value"), ["case_id", "key"], "left")
    entry = F.struct("key", F.coalesce("value", "default").alias("value"))
    return filled.groupBy("case_id", "section").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("fields"))


def benchmark_items(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions as layout items of a benchmark: its label of each kind, the box by corner and size; kinds without a label are left out."""
    out = regions.join(F.broadcast(labels), "kind")  # a label map is a fixed short list
    return out.select(*PAGE, "region_id", "label", F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


def write_metrics(rows: DataFrame, path: str) -> None:
    """Per-snippet metrics as CSV, one part per task."""
    rows.write.mode("overwrite").csv(path, header=True)


def retained(records: DataFrame, key: str, newest: str, keep: int) -> DataFrame:
    """The newest records of each key; a rewrite by key publishes them whole (write, then rename)."""
    w = Window.partitionBy(key).orderBy(F.desc(newest))
    return records.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")
