"""Consolidating pairwise matches into groups, by hash-to-min."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.staging import Staged


def _fingerprint(links: DataFrame):
    """Number and order-free checksum of the rows, in one pass."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("at", "member").cast("decimal(38,0)"))).first()


def consolidate(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Gives every record of ``pairs`` the smallest record that it is linked to, directly or indirectly.

    Returns ``record`` and ``group`` (of the pairs' type), one row for each record.

    Hash-to-min over rows (at, member): every vertex sends its cluster to the cluster's smallest member, and
    that member to all others, until no row changes. A cluster is never one value or one task: its minimum is
    pre-aggregated before the shuffle, its rows are hashed by both columns, and where a vertex holds so many
    that the join back is skewed, Spark splits it. Each round is a table on shared storage.

    Pairs with a null on either side don't count; a record paired with itself is its own group. Repeated pairs
    and both orientations are as one. Without pairs the result is empty. Other columns are ignored.
    """
    both = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    rows = F.explode(F.array(*(F.struct(F.col(x).alias("at"), F.col(y).alias("member")) for x, y in ("ab", "ba", "aa", "bb")))).alias("r")
    now = Staged(both.select(rows).select("r.*").distinct(), "links")
    seen = _fingerprint(now.df)
    while True:
        least = now.df.groupBy("at").agg(F.min("member").alias("least"))
        known = now.df.join(least, "at")
        sent = F.explode(F.array(F.struct(F.col("least").alias("at"), "member"), F.struct(F.col("member").alias("at"), F.col("least").alias("member")))).alias("r")
        then = Staged(known.select(sent).select("r.*").distinct(), "links")
        now.drop()
        now, before = then, seen
        seen = _fingerprint(now.df)
        if seen == before:
            return now.df.groupBy(F.col("at").alias("record")).agg(F.min("member").alias("group"))


def _plain(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def accepted_pairs(decisions: DataFrame) -> DataFrame:
    """left, right of each well-formed pair that any row accepts; ids and status trimmed and in lower case.

    A row is malformed where its list is null, isn't of two ids, has a null or blank one, or names one object twice.
    """
    ids = "candidate_source_object_ids"
    accepted = decisions.where((_plain(F.col("status")) == "accepted") & (F.size(ids) == 2))
    two = accepted.select(_plain(F.col(ids)[0]).alias("a"), _plain(F.col(ids)[1]).alias("b")).where("a <> '' AND b <> '' AND a <> b")
    return two.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()


def p3_found(spark, d: str) -> DataFrame:
    """The group of every object in an accepted pair: source_object_id, group_id."""
    pairs = accepted_pairs(spark.read.parquet(f"{d}/identity_decision.parquet"))
    return consolidate(pairs, "left", "right").select(F.col("record").alias("source_object_id"), F.col("group").alias("group_id"))


QUERIES = {"p3_found": p3_found}
SQL = {
    "p3_found": r"""
WITH RECURSIVE two AS (
  SELECT lower(regexp_replace(candidate_source_object_ids[1], '^\s+|\s+$', '', 'g')) AS a,
         lower(regexp_replace(candidate_source_object_ids[2], '^\s+|\s+$', '', 'g')) AS b
  FROM identity_decision
  WHERE lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'accepted' AND len(candidate_source_object_ids) = 2),
link AS (
  SELECT a, b FROM two WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM two WHERE a <> '' AND b <> '' AND a <> b),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS source_object_id, least(a, min(b)) AS group_id FROM reach GROUP BY a
"""
}
