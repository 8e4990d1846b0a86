"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u: link u and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    ``edges`` has long columns u and v; self loops, repeats and null ends are
    ignored, so a table without edges gives no rows. Each half round is written
    to the shared folder; only a count and a checksum reach the driver. Minima
    are partial aggregates, and the joins that follow read written tables, so
    Spark splits a hub's partition.
    """
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-edges",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = materialize(_large_star(edges), f"{name}-large")
        edges = materialize(_small_star(edges), f"{name}-small")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.groupBy("u").agg(F.min("v").alias("c"))
    return stars.select(F.col("u").alias("node"), F.col("c").alias("component")).unionByName(
        stars.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct()
    )
