"""Connected components of a link table, by alternating star contractions.

Every round turns neighbourhoods into stars around their smallest node: *large star* links
each node's larger neighbours to the smallest node of the neighbourhood, *small star* the
smaller ones. Both are one aggregation and one join, so no neighbourhood is ever gathered in
a task, and the number of rounds grows with the logarithm of the longest path. Every round
is a table in the shared folder; nothing but its row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: strictly larger neighbours of u to its minimum; small: the others."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; ``root`` is the smallest node of its component.

    Links may repeat, point either way or at themselves; null ends are ignored. No links, no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(rounds):
        edges = materialize(_star(_star(edges, True), False), "links")
        # A star forest is a fixed point: equal count and equal sum of hashed edges.
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)
