"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import saved

SALTS = 8  # tasks that share the edges of one node


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least v of its u; edges of one u are dealt to SALTS tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(least, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both).where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges have v < u."""
    linked = _with_least(edges)
    found = linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return found.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (columns u and v); root is the least node it reaches.

    Large and small stars in turn until nothing changes, each round written to the shared folder.
    The number of rounds grows with the logarithm of the largest component; every round keeps at
    most as many edges as before. Nodes are longs; loops and repeated edges are allowed, null ends are
    ignored, no edges give no rows.
    """
    found = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    found, before = saved(found.distinct()), None
    while True:
        found = saved(_small_star(_large_star(found)))
        state = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                found.select("v", "v").distinct()
            )
        before = state
