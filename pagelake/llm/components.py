"""Connected components by repeated hooking and contraction, entirely in Spark.

Each pass hooks every node to its least neighbour, shortens the hooks, and renames the links' ends; links inside a
component disappear. Nothing about single nodes reaches the driver, and every pass ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import discard, materialize


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; component is the least node reachable."""
    links = links.select("a", "b").filter("a <> b")
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "cc-hooks")
        for _ in range(2):  # a hook's target may itself be hooked
            far = hooks.select(F.col("node").alias("mid"), F.col("to").alias("far"))
            nearer = hooks.join(far, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("far", "to").alias("to"))
            nearer, old = materialize(nearer, "cc-hooks"), hooks
            discard(old)
            hooks = nearer
        ha, hb = hooks.select(F.col("node").alias("na"), F.col("to").alias("ta")), hooks.select(F.col("node").alias("nb"), F.col("to").alias("tb"))
        renamed = edges.join(ha, F.col("a") == F.col("na")).join(hb, F.col("b") == F.col("nb")).filter("ta <> tb")
        left = materialize(renamed.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            new = hooks.select("node", F.col("to").alias("component"))
            labels = materialize(new, "cc-labels")
        else:
            moved = labels.join(ha, F.col("component") == F.col("na"), "left").select("node", F.coalesce("ta", "component").alias("component"))
            moved, old = materialize(moved, "cc-labels"), labels
            discard(old)
            labels = moved
        discard(edges, hooks)
        edges = left
    discard(edges)
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b), given labels as ``connected`` returns them.

    Only the components that the new links' ends belong to are joined, so it costs passes over what is new and one over the
    labels. A node that neither names stays out, as in ``connected``; no links give the labels as they were."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias("en"), F.col("component").alias("ec"))
        ends = ends.join(of, F.col(end) == F.col("en"), "left").withColumn(end, F.coalesce("ec", end)).drop("en", "ec")
    above = connected(ends)
    up = above.select(F.col("node").alias("un"), F.col("component").alias("uc"))
    moved = labels.join(up, F.col("component") == F.col("un"), "left").select("node", F.coalesce("uc", "component").alias("component"))
    first = above.join(labels.select(F.col("node").alias("en")), F.col("node") == F.col("en"), "left_anti").select("node", "component")
    out = materialize(moved.unionByName(first), "cc-labels")
    discard(above, labels)
    return out
