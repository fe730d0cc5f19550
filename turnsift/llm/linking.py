"""Connected components by hooking and contraction, safe for hot vertices.

Every join has a written table on both sides, so Spark can split a vertex that holds a large
share of the edges; every grouping is a minimum, which is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.operators.durable import written


def _flat(parents: DataFrame) -> DataFrame:
    """Follow (high, low) to the end of every chain by doubling."""
    while True:
        above = parents.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        if parents.join(above, "low", "left_semi").isEmpty():
            return parents
        parents = written(
            parents.join(above, "low", "left").select("high", F.coalesce("lower", "low").alias("low")),
            "links-parents",
        )


def _moved(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the roots of their ends."""
    for end in ("a", "b"):
        to = parents.select(F.col("high").alias(end), F.col("low").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """vertex, label of all vertices seen so far, after adding edges (a, b).

    ``labels`` is the result of an earlier call; a vertex it lacks is its own label. The label
    of a component is its smallest vertex.
    """
    seen = edges.select(F.col("a").alias("vertex")).union(edges.select("b")).distinct()
    if labels is None:
        current = written(seen.withColumn("label", F.col("vertex")), "links-labels")
    else:
        fresh = seen.join(labels, "vertex", "left_anti").withColumn("label", F.col("vertex"))
        current = written(labels.unionByName(fresh), "links-labels")
    known = current.select(F.col("vertex").alias("high"), F.col("label").alias("low"))
    open_edges = written(_moved(edges.select("a", "b"), known), "links-edges")
    while not open_edges.isEmpty():
        hooks = written(
            open_edges.groupBy(F.col("a").alias("high")).agg(F.min("b").alias("low")), "links-parents"
        )
        parents = _flat(hooks)
        to = parents.select(F.col("high").alias("label"), F.col("low").alias("_to"))
        current = written(
            current.join(to, "label", "left").select("vertex", F.coalesce("_to", "label").alias("label")),
            "links-labels",
        )
        open_edges = written(_moved(open_edges, parents), "links-edges")
    return current
