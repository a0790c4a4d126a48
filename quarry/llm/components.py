"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is one node of its component, the same for all of it.

    Each round gives every node its least neighbour (an aggregate with map-side combining, so a hub is no hot
    group), follows these parents two steps, and contracts the links to what is left between different
    parents. Links shrink at each round; one count a round reaches the driver. Nulls take no part; repeated
    links, loops and an empty table are fine.
    """
    links = staged(links.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = staged(nodes.select("node", F.col("node").alias("root")), "roots")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        parent = staged(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("v").alias("uv"), F.col("p").alias("up"))
            parent = parent.join(up, F.col("p") == F.col("uv"), "left").select("v", F.coalesce("up", "p").alias("p"))
        parent = staged(parent, "parents")
        roots = staged(roots.join(parent, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        pa = parent.select(F.col("v").alias("va"), F.col("p").alias("pa"))
        pb = parent.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        moved = links.join(pa, F.col("a") == F.col("va")).join(pb, F.col("b") == F.col("vb"))
        links = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "links")
    return roots
