"""Connected components by alternating large-star and small-star rounds.

Vertices are longs. Every round is a fixed number of joins and pre-aggregated group-bys over edges, so no vertex's
neighbours are gathered anywhere: the least neighbour is a ``min`` aggregate (combined before the shuffle), and the
edges are re-pointed by a join on the vertex, which AQE splits where one vertex is hot. Lineage is cut by
``checkpoint`` into the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of longs -> (node, component), the least node of each component; one row per node.

    Self-loops give their node a component of its own. Null ends are ignored. An empty input gives no rows.
    ``most_rounds`` only guards against a defect: the number needed grows with the logarithm of the longest chain,
    and running out raises an error instead of returning a partial result.
    """
    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    nodes = clean.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
