"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (id, comp)`` after merging along ``links (a, b)``; a component is named by its smallest label.

    Components are contracted: each hangs itself below the smallest it is linked to, chains are followed to
    their root by doubling, and links within one component fall away, until none is left. Only the two
    tables are joined and grouped, so large components are no large groups of rows in one task.
    """
    here = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
    here = here.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    edges = written(here.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    roots = None
    while edges.limit(1).count():
        parent = edges.groupBy(F.col("y").alias("c")).agg(F.min("x").alias("p"))
        parent = written(parent, "parents")
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            parent = jumped.select("c", "p")
            if not jumped.where("moved").limit(1).count():
                break
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
            kept = roots.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"))
            roots = written(kept.unionByName(parent), "roots")
        for end in ("x", "y"):
            up = parent.select(F.col("c").alias(end), F.col("p").alias("q"))
            edges = edges.join(up, end, "left").withColumn(end, F.coalesce("q", end)).drop("q")
        edges = edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        edges = written(edges, "links")
    if roots is None:
        return labels
    up = roots.select(F.col("c").alias("comp"), F.col("p").alias("root"))
    return written(labels.join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
