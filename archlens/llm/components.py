"""Connected components by contraction, over written tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from archlens.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): equal roots if and only if connected.

    Each round every node hooks on the neighbour (or itself) that is first in a
    hashed order, links move to the hooks, and links inside one hook vanish. A
    hashed order leaves a constant fraction of the nodes on any shape, stars
    and chains alike, so rounds grow with the logarithm. Hooks are minima, so
    a node with very many links is pre-aggregated, and its rows in the joins
    are split like any skewed key. Only a row count comes to the driver.
    Nulls and loops are ignored; the root is one node of the component.
    """
    links = links.where("a <> b")
    edges = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct())
    order = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    found = None
    while True:
        hooks = cut_lineage(edges.groupBy("a").agg(F.min(order("b")).alias("best"))
                            .select("a", F.least("best", order("a"))["id"].alias("hook")))
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("hook").alias("root"))
        else:
            step = hooks.select(F.col("a").alias("root"), "hook")
            found = cut_lineage(found.join(step, "root", "left")
                                .select("node", F.coalesce("hook", "root").alias("root")))
        other = hooks.select(F.col("a").alias("b"), F.col("hook").alias("other"))
        edges = cut_lineage(edges.join(hooks, "a").join(other, "b").where("hook <> other")
                            .select(F.col("hook").alias("a"), F.col("other").alias("b")).distinct())
        if edges.isEmpty():
            return found
