"""Connected components by alternating large-star and small-star steps: joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm.common import delete, written


def _towards(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node to the least of the node and its neighbours (large-star: the larger ones only)."""
    ends = edges.select("u", "v")
    if larger_only:
        ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    both = ends.join(least, "u")
    if larger_only:
        out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the least node that can be reached.

    Null ends and loops are left out. Every round is written to the shared folder, and only two numbers (the count and
    a checksum of the edges) come to the driver.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct()
    edges, seen = written(edges, "links"), None
    for _ in range(most_rounds):
        before, edges = edges, written(_towards(_towards(edges, True), False), "links")
        delete(before)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    own = edges.select(F.col("v").alias("u"), "v").distinct()
    found = written(edges.unionByName(own).select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
    delete(edges)
    return found
