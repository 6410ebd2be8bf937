"""Records from sources: checks, rejects, coverage, ledgers, versions and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import canonical_json, stable_id
from tessella.functions.text import collapsed


def required(*columns: str) -> Column:
    """True where all are strings that aren't empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(c) > 0, F.lit(False))
    return out


def rejected_for(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that fails (null counts as failing); null where all hold."""
    out = F.lit(None).cast("string")
    for reason, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def source_objects(df: DataFrame, system: str, kind: str, native: str, digest: str) -> DataFrame:
    """df with ``object_id``, stable for (system, kind, native id, digest)."""
    return df.withColumn("object_id", stable_id("source_object", canonical_json({"digest": F.col(digest), "kind": F.col(kind), "native": F.col(native), "system": F.col(system)})))


def coverage(accepted: DataFrame, rejected: DataFrame, system: str) -> DataFrame:
    """system, objects, status of what a run covered: partial for every system if any record was rejected, whichever it was of.

    A system whose records are all rejected has a slice that failed, where rejects tell their system.
    """
    flawed = rejected.agg((F.count(F.lit(1)) > 0).alias("flawed"))
    counts = accepted.groupBy(system).agg(F.count(F.lit(1)).alias("objects"))
    slices = counts.crossJoin(F.broadcast(flawed)).select(system, "objects", F.when(F.col("flawed"), "partial").otherwise("complete").alias("status"))
    if system not in rejected.columns:
        return slices
    lost = rejected.select(system).where(F.col(system).isNotNull()).distinct().join(counts, system, "left_anti")
    return slices.unionByName(lost.select(system, F.lit(0).cast("bigint").alias("objects"), F.lit("failed").alias("status")))


def ledger(records: DataFrame, run: str, system: str, native: str, digest: str, reject: str) -> DataFrame:
    """run, system, accepted, skipped (repeats of a record within the run), rejected, natives, divergent (natives with several digests).

    Counts by record first, so a system with a third of all rows is spread by its records.
    """
    fine = records.where(F.col(reject).isNull()).groupBy(run, system, native, digest).agg(F.count(F.lit(1)).alias("n"))
    by_native = fine.groupBy(run, system, native).agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("n"))
    good = by_native.groupBy(run, system).agg(F.sum("digests").alias("accepted"), F.sum(F.col("n") - F.col("digests")).alias("skipped"), F.count(F.lit(1)).alias("natives"), F.count_if(F.col("digests") > 1).alias("divergent"))
    bad = records.where(F.col(reject).isNotNull()).groupBy(run, system).agg(F.count(F.lit(1)).alias("rejected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return good.join(bad, [run, system], "full").select(run, system, *(zero(c) for c in ("accepted", "skipped", "rejected", "natives", "divergent")))


def acquire(corpus: DataFrame, wanted: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """The wanted records, byte-identical repeats once and divergent versions all; and the wanted keys that the corpus lacks."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return corpus.join(keys, key, "left_semi").dropDuplicates([key, digest]), keys.join(corpus, key, "left_anti")


def version_groups(objects: DataFrame, system: str, native: str, digest: str, item: str) -> DataFrame:
    """Each version of a native id with two digests or more: system, native, digest, item (the digest's least), versions, anchor_item, is_anchor.

    The anchor is the least by digest; versions have no known order.
    """
    distinct = objects.where(F.col(native).isNotNull() & F.col(digest).isNotNull()).groupBy(system, native, digest).agg(F.min(item).alias(item))
    groups = distinct.groupBy(system, native).agg(F.count(F.lit(1)).alias("versions"), F.min(F.struct(digest, item)).alias("anchor")).where("versions > 1")
    joined = distinct.join(groups, [system, native])
    return joined.select(system, native, digest, item, "versions", F.col(f"anchor.{item}").alias("anchor_item"), (F.col(item) == F.col(f"anchor.{item}")).alias("is_anchor"))


def duplicate_pairs(objects: DataFrame, item: str, kind: str, native: str, digest: str, content: str) -> DataFrame:
    """left, right, class of pairs that are exact (digest), version_candidate (kind and native id) or near (kind and collapsed content).

    ``kind`` tells systems and types apart: equal native ids of two systems are no versions.

    Pairs meet by equality only; of several classes the first counts. Equal contents are chained to the least item of
    their class, (least, other), so that a class costs its rows and not its pairs. So are the objects of a native id, which
    aren't copies: ``version_links`` has the links of its payloads, all of them.
    """
    base = objects.select(F.col(item).alias("id"), F.col(kind).alias("kind"), F.col(native).alias("native"), F.col(digest).alias("digest"), F.md5(collapsed(F.col(content))).alias("body"))
    kinds = [("exact", 1, ["digest"]), ("version_candidate", 2, ["kind", "native"]), ("near", 3, ["kind", "body"])]
    every = None
    for name, order, keys in kinds:
        have = base.dropna(subset=keys)
        least = have.groupBy(*keys).agg(F.min("id").alias("left"))
        one = have.join(least, keys).where("left < id").select("left", F.col("id").alias("right"), F.lit(order).alias("o"), F.lit(name).alias("class"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("left", "right").agg(F.min_by("class", "o").alias("class"))


def payload_members(objects: DataFrame, system: str, kind: str, native: str, digest: str, item: str) -> DataFrame:
    """system, kind, native, digest, item and ``representative``, the least item with the same payload under the same native id.

    A row an object that has all of the four; what holds for a representative in ``version_links`` holds for its copies.
    """
    keys = list(dict.fromkeys([system, kind, native, digest]))
    have = objects.select(*keys, item).dropna(subset=keys)
    return have.join(have.groupBy(*keys).agg(F.min(item).alias("representative")), keys)


def version_links(objects: DataFrame, system: str, kind: str, native: str, digest: str, item: str) -> DataFrame:
    """system, kind, native, left, right: every two different payloads of one native id of a system and kind, as their representatives.

    Copies of a payload are one (``payload_members`` tells them), versions are not: n payloads have n (n - 1) / 2 links.
    """
    same = list(dict.fromkeys([system, kind, native]))
    each = objects.dropna(subset=[*same, digest]).groupBy(*same, digest).agg(F.min(item).alias("i"))
    side = lambda x: each.select(*same, F.col(digest).alias(f"{x}_digest"), F.col("i").alias(f"{x}_i"))
    pairs = side("l").join(side("r"), same).where("l_digest < r_digest")
    return pairs.select(*same, F.least("l_i", "r_i").alias("left"), F.greatest("l_i", "r_i").alias("right"))


def once(df: DataFrame, keys: list[str], best_first: list[Column]) -> DataFrame:
    """The first row of each key in an order that tells rows apart."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where("__k = 1").drop("__k")
