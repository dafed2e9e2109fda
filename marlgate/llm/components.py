"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.llm.scratch import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v.

    The minimum is combined on the map side, so a hot u costs one row a task.  It is written, so that the join has exchanges of its
    own, of which a partition with a hot u can be split.
    """
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (lo, hi); component is the least node reachable.

    Nothing is gathered in one place: a round is two aggregations and joins, written to the shared folder.  Loops and repeated
    edges do no harm, null ends are ignored, and no edges give an empty table.
    """
    tree = cut(edges.where("lo <> hi").select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).distinct(), "edges")
    while True:
        both = tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        small = _smallest(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        tree = cut(small, "edges")
        # done when each node has one edge, to a node that has none of its own
        parents = tree.select(F.col("v").alias("u"), F.lit(1).alias("p")).distinct()
        degree = tree.select("u", F.lit(0).alias("p")).union(parents).groupBy("u").agg(F.count("*").alias("n"))
        if degree.where("n > 1").isEmpty():
            break
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
