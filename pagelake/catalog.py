"""Named queries of the engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.plans import evidence, inventory, relational, reviews, text_risks, values
from pagelake.session import table

QUERIES = text_risks.QUERIES | values.QUERIES | relational.QUERIES | evidence.QUERIES | reviews.QUERIES | inventory.QUERIES
ORACLES = text_risks.ORACLES | values.ORACLES | relational.ORACLES | evidence.ORACLES | reviews.ORACLES | inventory.ORACLES


def FLAGSHIP(spark, sf_dir):
    """The review queue: every document with its risks, its first copy and its route."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    risks = text_risks.doc_text_risks(spark, sf_dir)
    copies = text_risks.exact_duplicates(spark, sf_dir)
    out = docs.join(risks, "doc_id", "left").join(copies, "doc_id", "left")
    doubt = F.coalesce(F.col("n_risks"), F.lit(0)) + F.col("duplicate_of").isNotNull().cast("long")
    return out.select("doc_id", "source", "n_chars", F.coalesce("risks", F.lit("")).alias("risks"), "duplicate_of", F.when(doubt > 0, "review").otherwise("accept_local").alias("route"))
