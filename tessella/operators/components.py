"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.staging import Staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex points its larger (or its other) neighbours at its least neighbour, itself included."""
    turned = F.col("u") > F.col("v")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    moved = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.when(turned, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(turned, F.col("v")).otherwise(F.col("u")).alias("v")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, vertices: DataFrame | None = None) -> DataFrame:
    """vertex, component (its smallest vertex) of an undirected graph.

    Stars of a vertex are rows, never a list; each round is a table on shared storage. ``vertices`` (column
    ``vertex``) adds those without an edge. Null ends don't count; loops and repeated edges are harmless.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("vertex"))
    every = (ends if vertices is None else ends.unionByName(vertices.select("vertex"))).distinct()
    now = Staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        mark = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        then = Staged(_stars(_stars(now.df, large=True), large=False), "stars")
        now.drop()
        now = then
    found = now.df.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component"))
    return every.join(found, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
