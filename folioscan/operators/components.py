"""Connected components of an edge table, as alternating star contractions.

Each round runs one large-star and one small-star step (Kiveris et al., 2014):
partial aggregation finds every node's least neighbour, a join on the node hands
it to the neighbours.  The minima are written first, so both join inputs are plain
exchanges of which adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.storage import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _down(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has an edge.

    ``edges`` has long columns ``u`` and ``v``; direction, repeats and self-loops
    do not matter, rows with a null end are ignored.  ``component`` is the least
    node reachable, the node itself included.  An empty table gives an empty table.
    """
    cur = materialize(_down(edges.dropna(subset=["u", "v"]).select("u", "v")), "cc")
    mark = _signature(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = materialize(least.select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "cc")
        # large star: the larger end of every edge learns the least neighbour of the smaller end
        large = cur.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
        large = materialize(_down(large), "cc")
        # small star: all smaller neighbours of a node, and the node, point at the least of them
        least = materialize(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "cc")
        hung = large.join(least, F.col("u") == F.col("n"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("n").alias("u"), F.col("m").alias("v"))
        )
        nxt = materialize(_down(small), "cc")
        after = _signature(nxt)
        if after == mark:
            break
        cur, mark = nxt, after
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
