"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``vertex``, ``component`` (the smallest vertex it is connected with) for each vertex of a link.

    In each round every vertex points to its smallest neighbour, links move to what their ends
    point to, and repeated links and loops go; rounds end when no link is left. Each round is
    written to the shared folder and removes the one before, so lineage stays short and a lost
    executor costs one round. ``scratch`` takes over the result's table.
    Nulls and loops are no links; an empty table gives no rows.
    """
    own, turn, labels = Scratch(links.sparkSession), 0, None
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = own.write(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges0")
    while True:
        turn += 1
        parents = edges.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parents = own.write(parents, "parents")
        if labels is None:
            labels = parents.select(F.col("u").alias("vertex"), F.col("p").alias("component"))
        else:
            moved = parents.select(F.col("u").alias("component"), "p")
            labels = labels.join(moved, "component", "left").select("vertex", F.coalesce("p", "component").alias("component"))
        labels = own.write(labels, f"labels{turn}")
        ends = edges.join(parents, "u").select(F.col("p").alias("x"), "v")
        ends = ends.join(parents.select(F.col("u").alias("v"), F.col("p").alias("y")), "v").where("x <> y")
        edges = own.write(ends.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), f"edges{turn}")
        own.drop(f"labels{turn}", f"edges{turn}")
        if edges.isEmpty():
            own.drop(f"labels{turn}")
            if scratch:
                scratch.paths.update(own.paths)
            return labels
