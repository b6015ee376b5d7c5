"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import checkpoint as written
from lectern.llm.batches import spread_join


def components(folder: str, links: DataFrame) -> DataFrame:
    """`links`: columns a, b of any one orderable type.  Gives (node, root) for each node that has a link; root is the least of its component.

    Each round every node points to its least neighbour or itself, pointers are doubled
    until they end at roots, and links are drawn anew between these.  Every round halves
    the nodes at least, and doublings are as many as the logarithm of the longest chain.
    All state stays in tables within `folder`; a root that most nodes point to is no hot key, as nodes
    look up their pointers by groups.
    """
    checkpoint = partial(written, within=folder)
    edges = checkpoint(links.select("a", "b").where("a <> b").distinct())
    roots = checkpoint(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("p"))
        point, moved = checkpoint(point), True
        while moved:
            up = point.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            doubled = spread_join(point, up, ["p"], F.col("n"))
            point = checkpoint(doubled.select("n", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = not point.where("moved").isEmpty()
        after = point.select(F.col("n").alias("root"), F.col("p").alias("next"))
        roots = checkpoint(spread_join(roots, after, ["root"], F.col("node"), "left").select("node", F.coalesce("next", "root").alias("root")))
        left, right = point.select(F.col("n").alias("a"), F.col("p").alias("pa")), point.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        drawn = spread_join(spread_join(edges, left, ["a"], F.col("b")), right, ["b"], F.col("a"))
        edges = checkpoint(drawn.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    return roots
