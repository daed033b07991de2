"""Connected components of a table of links, without a node's links meeting in one place for good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import forget, keep


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links(a, b)`` that is not its component.

    Links are read in either direction; a null end or a link to itself says nothing. Each round hangs a node's smaller
    neighbours, and the node, onto the smallest of them, until each node has one smaller neighbour; nodes then jump
    to their parent's parent. Only larger nodes are grouped by, so the centre of a star gathers nothing. The
    joins' large sides are plain rows, which Spark can split where one parent has very many children.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    tree = keep(links.where("a <> b").select(b.alias("node"), a.alias("near")).distinct(), "links")
    while True:
        grouped = keep(tree.groupBy("node").agg(F.array_sort(F.collect_set("near")).alias("near")), "grouped")
        forget(tree)
        if grouped.where(F.size("near") > 1).isEmpty():
            break
        least = F.col("near")[0]
        moved = grouped.select(F.explode(F.concat(F.array("node"), F.slice("near", 2, F.greatest(F.size("near") - 1, F.lit(0))))).alias("node"),
                               least.alias("near"))
        tree = keep(moved.distinct(), "links")
        forget(grouped)
    parent = keep(grouped.select("node", F.col("near")[0].alias("component")), "parents")
    forget(grouped)
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("component").alias("top"))
        jumped = keep(parent.join(above, F.col("component") == F.col("up"), "left")
                      .select("node", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")), "parents")
        forget(parent)
        parent = jumped.drop("moved")
        parent._kept_at = jumped._kept_at
        if jumped.where("moved").isEmpty():
            return parent
