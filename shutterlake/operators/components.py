"""Connected components by alternating stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node that it can see."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.withColumnRenamed("m", "dst")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the least node reachable.

    Direction, repeats and loops don't matter; a node that only has a loop is its own component; rows with a
    null end are ignored. The frame is empty if ``edges`` is. Each round halves distances to the least node;
    its edges go through the shared folder. Degree is never gathered: stars are built by a partial
    aggregate and a join that adaptive execution can split.
    """
    given = cut(edges.select("src", "dst").filter("src is not null and dst is not null"))  # evaluated once, whatever made it
    nodes = cut(given.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    edges = cut(given.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.hash("src", "dst").cast("long"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return nodes.join(edges, nodes.node == edges.src, "left").select("node", F.coalesce("dst", "node").alias("component"))
