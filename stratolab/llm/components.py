"""Connected components of an edge table by hooking to neighbours in a random order and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Each round nodes are ordered by a hash drawn anew; a node is mapped to the first among itself and its neighbours,
    and once more to where that is mapped. Edges between what is left then go into the next round, each
    once. As no order of the ids survives, rounds grow with the logarithm of the longest shortest path, chains of ascending ids
    included. At the end the smallest node names its component. A round's tables are written to
    the shared folder. A node that many rows name is left to the skew handling of adaptive
    execution. Null ends and loops take no part. No edges give no rows.
    """
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = stored(edges.where("a is not null and b is not null and a != b").select(*ends("a", "b")).distinct(), "edges")
    known, turn = None, 0
    while known is None or not left.isEmpty():
        place = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near"))
        near = near.select("node", F.least(place("node"), "near")["n"].alias("to"))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        labels = stored(near.join(far, "to").select("node", F.col("far").alias("to")), "labels")
        of_a, of_b = (labels.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = left.join(of_a, "a").join(of_b, "b").where("to_a != to_b")
        left = stored(moved.select(*ends("to_a", "to_b")).distinct(), "edges")
        if known is None:
            known = labels
        else:
            later = labels.select(F.col("node").alias("to"), F.col("to").alias("root"))
            known = stored(known.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
        turn += 1
    return known.join(known.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root")
