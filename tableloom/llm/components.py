"""Connected components of a link table, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a long, b long).

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots by
    repeated self-joins, and contracts the links to roots; links inside a tree vanish. A round at
    least halves the nodes, and pointer following takes a logarithm of the longest chain. Every
    step is written to the shared folder, so no plan grows and a lost executor loses one step.

    Rows with a null end or a = b link nothing; repeated links count once; no links, no rows.
    """
    links = materialize(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        tree = both.groupBy("a").agg(F.min("b").alias("b"))
        tree = materialize(tree.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooked")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = tree.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            step = materialize(step, "followed")
            tree = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        rounds.append(tree)
        left = tree.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = tree.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = materialize(links.distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0]
    for tree in rounds[1:]:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return found.select("node", F.col("root").alias("component"))
