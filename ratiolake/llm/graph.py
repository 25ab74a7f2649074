"""Connected components of graphs that live in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each id of edges (a, b), comp the smallest id it can reach.

    In each round every id joins its smallest neighbour, and that one's; then the graph is contracted to
    what lies between different joined ids, until no edge is left. Rounds grow with the logarithm of the
    longest path, and only the first sees all edges. Each round is written to the shared folder. Loops and
    repeated edges do no harm.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    labels = written(ends.withColumn("comp", F.col("id")), "labels")
    left = left.filter("a <> b")
    while not left.isEmpty():
        # each step is written before the next, so that the rows of a hub are dealt out anew and can be split
        lower = written(left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to")), "lower")
        again = lower.toDF("to", "next")
        joins = written(lower.join(again, "to", "left").select("v", F.coalesce("next", "to").alias("to")), "joins")
        labels = written(labels.join(joins, labels["comp"] == joins["v"], "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            left = left.join(joins.toDF(end, "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = written(written(left, "between").distinct(), "edges")
    return labels
