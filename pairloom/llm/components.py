"""Connected components of an undirected edge list, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable from each vertex of ``edges``
    (a, b), both bigint.

    Every round each vertex takes the smallest label among itself and its
    neighbours, then the label of its label, so distances shrink by half or
    better.  Each round's labels are written to the shared folder; only one
    count per round reaches the driver."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        above = step.select(F.col("v").alias("comp"), F.col("comp").alias("up"))
        new = stored(step.join(above, "comp", "left").select("v", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        labels = new.select("v", "comp")
        if new.where("comp <> old").isEmpty():
            return labels
