"""A property graph as two tables: building, upserts, paths and fingerprints.

nodes: label, id; edges: type, src, dst (and any further columns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import canonical_json, stable_id
from tessella.staging import Staged


def nodes_of(df: DataFrame, label: str, key: str) -> DataFrame:
    """label, id of every distinct key."""
    return df.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("id")).distinct()


def edges_of(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """type, src, dst of every distinct pair of keys; (label, key) names an end."""
    end = lambda x: F.concat(F.lit(x[0] + ":"), F.col(x[1]).cast("string"))
    return df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()).select(F.lit(kind).alias("type"), end(src).alias("src"), end(dst).alias("dst")).distinct()


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def edge_id(discriminator: Column | None = None) -> Column:
    """An edge's identity: its type and ends, and what tells parallel edges apart."""
    fields = {"dst": F.col("dst"), "src": F.col("src"), "type": F.col("type")}
    return stable_id("edge", canonical_json(fields | ({"via": discriminator} if discriminator is not None else {})))


def merge_latest(waves: DataFrame, keys: list[str], wave: str) -> DataFrame:
    """Of several waves of writes the last row of each key: replaying a wave changes nothing."""
    best = Window.partitionBy(*keys).orderBy(F.col(wave).desc(), F.hash(*waves.columns))
    return waves.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def upsert_exclusive(existing: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Edges after a batch in which a source has one edge of ``kind`` at most: the batch's replaces any before."""
    mine = new.where(F.col("type") == kind).groupBy("type", "src").agg(F.max("dst").alias("dst"))
    replaced = mine.select("src", F.lit(kind).alias("type"))
    kept = existing.join(replaced, ["src", "type"], "left_anti").select("type", "src", "dst")
    return kept.unionByName(new.where(F.col("type") != kind).select("type", "src", "dst")).unionByName(mine).distinct()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("id")
    lost = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("type", "src", "dst")
    return lost("src").unionByName(lost("dst")).distinct()


def follow(start: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """start, end of the paths from ``start`` (column ``id``) along edges of exactly these types, in order."""
    at = start.select(F.col("id").alias("start"), F.col("id").alias("end"))
    for kind in kinds:
        step = edges.where(F.col("type") == kind).select(F.col("src").alias("end"), F.col("dst").alias("__next"))
        at = at.join(step, "end").select("start", F.col("__next").alias("end"))
    return at


def distances(start: DataFrame, edges: DataFrame, kinds: list[str], most: int) -> DataFrame:
    """start, end, hops: the fewest hops, up to ``most``, from each start along edges of these types, level by level.

    A vertex that is reached is never left again for the same start, so a round handles the new ones alone.
    """
    step = edges.where(F.col("type").isin(*kinds)).select(F.col("src").alias("end"), F.col("dst").alias("__next")).distinct()
    seen = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, most + 1):
        onward = front.join(step, "end").select("start", F.col("__next").alias("end")).distinct()
        new = Staged(onward.join(seen, ["start", "end"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        front = new.df
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def fingerprint(frame: DataFrame, columns: list[str]) -> DataFrame:
    """rows and a digest of a table's content in any order and partitioning: the sum of its rows' 96-bit digests, of distinct rows.

    One row a task is shuffled, whatever the size of the table.
    """
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)))
    part = lambda i: F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return frame.select(*columns).distinct().agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("-", *(part(i) for i in range(3))), 256).alias("digest"))
