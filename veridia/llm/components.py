"""Connected components of a distributed edge table.

Each round contracts the graph: every node takes the smallest label among
itself and its neighbours, labels are shortened by pointer jumping, and edges
are rewritten to labels with loops and repeats removed. Only aggregates over
keys (with map-side partials) and sort-merge joins are used, so a node with a
large share of all edges is split by AQE. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component = smallest node.

    Nulls and loops link nothing; repeated and reversed edges count once. An
    empty table gives an empty table.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live, steps = store(pairs.distinct(), tag), []
    first = live
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        up = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = store(low.join(up, "label").select("node", F.col("up").alias("label")), tag)
        a = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = live.join(a, "a").join(b, "b").where("la <> lb")
        left = store(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), tag)
        if live is not first:
            drop_stored(live)
        live = left
        steps.append(step)
    out = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().select("node", F.col("node").alias("component"))
    for i, step in enumerate(steps):
        step = step.withColumnRenamed("node", "component")
        out = out.join(step, "component", "left" if i else "inner").select("node", F.coalesce("label", "component").alias("component"))
    out = store(out, tag)
    drop_stored(first, *steps)
    return out
