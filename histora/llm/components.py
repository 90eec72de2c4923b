"""Connected components of a graph of pairs, by alternating large-star and small-star rounds.

Each round is a few joins and aggregations over the edges; hubs are aggregated
before they are joined, so a vertex with a third of all edges is no hot spot that
a skew join could not split. Edges never come to the driver; two sums do, to see
whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_ROUNDS = 60


def _linked(edges: DataFrame, both: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = sides.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = sides.join(least, sides["u"] == least["at"])
    if both:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    up = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.unionAll(near.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) for each id in pairs (a, b); component is the smallest id it is connected with."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = sign(edges)
    for _ in range(MOST_ROUNDS):
        if not was[0]:
            break
        edges = stored(_linked(_linked(edges, True), False), "edges")
        now = sign(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
