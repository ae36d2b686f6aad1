"""Connected components by alternating large and small stars; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are hung on the least of these. ``u`` is above ``v`` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``edges(u, v)``, the least id of the component; ids that occur in no edge are left out.

    The number of rounds grows with the logarithm of the number of edges. Every
    round is a table in the shared folder.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = stored(ordered, "edges")
    state = None
    while True:
        signs = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if signs["n"] == 0 or (signs["n"], signs["s"]) == state:
            break
        state = signs["n"], signs["s"]
        now = stored(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
