"""The evidence graph: its nodes and edges out of tables of facts, and the reads that answer questions from it.

nodes: label, id; edges: type, src, dst, role (which side of a decision, else null).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import canonical_json, stable_id
from tessella.staging import stage


def node(df: DataFrame, label: str, key: Column | str) -> DataFrame:
    """label, id of every distinct key that isn't null."""
    k = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(label).alias("label"), k.cast("string").alias("id")).where("id IS NOT NULL").distinct()


def edge(df: DataFrame, kind: str, src: Column | str, dst: Column | str, role: Column | None = None) -> DataFrame:
    """type, src, dst, role of every distinct pair of ends that aren't null."""
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    made = df.select(F.lit(kind).alias("type"), c(src).alias("src"), c(dst).alias("dst"), (F.lit(None).cast("string") if role is None else role).alias("role"))
    return made.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, fault, edges: how many edges lack which end; and repeated node ids under two labels. Empty for a whole graph."""
    ids = nodes.select("id").distinct()
    known = ids.withColumn("known", F.lit(True))
    ends = edges.join(known.toDF("src", "s"), "src", "left").join(known.toDF("dst", "t"), "dst", "left")
    fault = F.when(F.col("s").isNull() & F.col("t").isNull(), "both_missing").when(F.col("s").isNull(), "source_missing").when(F.col("t").isNull(), "target_missing")
    lost = ends.select("type", fault.alias("fault")).where("fault IS NOT NULL").groupBy("type", "fault").agg(F.count(F.lit(1)).alias("edges"))
    twice = nodes.groupBy("id").agg(F.count_distinct("label").alias("n")).where("n > 1").agg(F.lit("node").alias("type"), F.lit("two_labels").alias("fault"), F.count(F.lit(1)).alias("edges")).where("edges > 0")
    return lost.unionByName(twice)


def paths(pairs: DataFrame, edges: DataFrame, kinds: list[str], most_hops: int, most_paths: int) -> DataFrame:
    """start, end, hops, nodes, types, place: whole simple paths along edges of these types, the first ``most_paths`` of each pair by length, then nodes.

    pairs: start, end. A path doesn't leave its end again and visits no node twice. Ends are reached by a bounded number of joins, level by
    level, each a table on shared storage; only nodes from which an end may still be reached go on, as walking back from the ends tells.
    """
    if not 1 <= most_hops <= 16 or not 1 <= most_paths <= 100 or not kinds:
        raise ValueError("paths need 1 to 16 hops, 1 to 100 paths and an edge type")
    step = edges.where(F.col("type").isin(*kinds)).select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("type").alias("by")).distinct()
    pairs = pairs.select("start", "end").where("start IS NOT NULL AND end IS NOT NULL").distinct()
    # the nodes from which some end is reached within the hops that are left
    near, reach = pairs.select(F.col("end").alias("node")).distinct(), []
    for _ in range(most_hops):
        reach.append(near)
        near = stage(near.unionByName(step.join(near.withColumnRenamed("node", "next"), "next", "left_semi").select(F.col("at").alias("node"))).distinct(), "reach")
    front = pairs.join(near.withColumnRenamed("node", "start"), "start", "left_semi").select("start", "end", F.col("start").alias("at"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("types"))
    found = []
    for hop in range(1, most_hops + 1):
        on = front.join(step, "at").where(~F.array_contains("nodes", F.col("next"))).select("start", "end", F.col("next").alias("at"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("types", F.array("by")).alias("types"))
        on = stage(on.join(reach[most_hops - hop].withColumnRenamed("node", "at"), "at", "left_semi"), "front")
        found.append(on.where("at = end").select("start", "end", F.lit(hop).alias("hops"), "nodes", "types"))
        front = on.where("at <> end")
    order = Window.partitionBy("start", "end").orderBy("hops", "nodes", "types")
    return reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_paths)


def requested_paths(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """start, end, hops, nodes, types of the first path of every requested pair; null where there is none, which is a fault of the request."""
    first = found.where("place = 1").drop("place")
    return pairs.select("start", "end").distinct().join(first, ["start", "end"], "left")


def sequence(start: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """start, nodes, fault of the one path along exactly these types in order: null, ``missing`` or ``ambiguous`` (with null nodes).

    Each hop has to have one target. start: id.
    """
    at = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.lit(None).cast("string").alias("fault"))
    for kind in kinds:
        hop = edges.where(F.col("type") == kind).groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("next"), F.count_distinct("dst").alias("n"))
        at = at.join(hop, "at", "left")
        fault = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
        at = at.select("start", "next", F.concat("nodes", F.array("next")).alias("nodes"), fault.alias("fault")).select("start", F.when(F.col("fault").isNull(), F.col("next")).alias("at"), F.when(F.col("fault").isNull(), F.col("nodes")).alias("nodes"), "fault")
    return at.select("start", "nodes", "fault")


def proof_faults(found: DataFrame, kinds: list[str], nodes: DataFrame, source: str, target: str, shortest: int, longest: int) -> DataFrame:
    """start, end, fault of each path (nodes, types) that must be of exactly these types, between these labels and bounds: null where all hold."""
    label = lambda x: nodes.groupBy(F.col("id").alias(x)).agg(F.min("label").alias(f"{x}_label"))
    both = found.join(label("start"), "start", "left").join(label("end"), "end", "left")
    wanted = F.array(*map(F.lit, kinds))
    fault = F.when(~F.col("hops").between(shortest, longest), "length").when(F.size("nodes") != F.col("hops") + 1, "not_contiguous").when(F.col("types") != wanted, "relationships").when((F.element_at("nodes", 1) != F.col("start")) | (F.element_at("nodes", -1) != F.col("end")), "endpoints").when(~F.col("start_label").eqNullSafe(F.lit(source)) | ~F.col("end_label").eqNullSafe(F.lit(target)), "labels")
    return both.select("start", "end", fault.alias("fault"))


def hop(left: DataFrame, edges: DataFrame, kind: str, at: str, to: str, back: bool = False, role: str | None = None) -> DataFrame:
    """left with ``to``, what an edge of ``kind`` leads to from ``at`` (or, ``back``, what leads to it), and the edge's role."""
    a, b = ("dst", "src") if back else ("src", "dst")
    own = edges.where(F.col("type") == kind).select(F.col(a).alias(at), F.col(b).alias(to), *([F.col("role").alias(role)] if role else []))
    return left.join(own, at)


def observation_evidence(edges: DataFrame) -> DataFrame:
    """entity, claim, observation, source of every observation that a claim about an entity rests on: three hops."""
    start = edges.where("type = 'ASSERTS'").select(F.col("src").alias("entity"), F.col("dst").alias("claim"))
    return hop(hop(start, edges, "OBSERVED_AS", "claim", "observation"), edges, "OBSERVED_IN", "observation", "source").select("entity", "claim", "observation", "source")


def conflict_decisions(edges: DataFrame, resolutions: DataFrame) -> DataFrame:
    """conflict, left_claim, right_claim, policy, resolution, winner, fault: both sides of each conflict and what decided it.

    resolutions: conflict, resolution. A fault is one of ``sides`` (not one claim on each), ``same_claim``, ``undecided`` (resolved without a policy)
    or ``needless_policy`` (unresolved with one).
    """
    sides = edges.where("type = 'CONSIDERS' AND role IN ('left', 'right')").groupBy(F.col("src").alias("conflict"))
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("dst")))
    held = sides.agg(of("left").alias("left_claim"), of("right").alias("right_claim"), F.count_if(F.col("role") == "left").alias("l"), F.count_if(F.col("role") == "right").alias("r"))
    policy = edges.where("type = 'DECIDED_BY'").groupBy(F.col("src").alias("conflict")).agg(F.min("dst").alias("policy"))
    both = held.join(resolutions, "conflict").join(policy, "conflict", "left")
    settled = F.col("resolution").isin("left", "right")
    fault = F.when((F.col("l") != 1) | (F.col("r") != 1), "sides").when(F.col("left_claim") == F.col("right_claim"), "same_claim").when(settled & F.col("policy").isNull(), "undecided").when(~F.coalesce(settled, F.lit(False)) & F.col("policy").isNotNull(), "needless_policy")
    winner = F.when(F.col("resolution") == "left", F.col("left_claim")).when(F.col("resolution") == "right", F.col("right_claim"))
    return both.select("conflict", "left_claim", "right_claim", "policy", "resolution", winner.alias("winner"), fault.alias("fault"))


def identity_decisions(edges: DataFrame) -> DataFrame:
    """decision, considers, supported_by, blocked_by, supersedes: sorted lists of what each decision is about."""
    kinds = {"CONSIDERS": "considers", "SUPPORTED_BY": "supported_by", "BLOCKED_BY": "blocked_by", "SUPERSEDES": "supersedes"}
    own = edges.where(F.col("type").isin(*kinds)).groupBy(F.col("src").alias("decision"))
    return own.agg(*(F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("dst")))).alias(v) for k, v in kinds.items()))


def resolved_entities(edges: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """source, entity, fault: the one entity that each source resolves to; ``missing`` or ``ambiguous`` otherwise."""
    own = edges.where("type = 'RESOLVES_TO'").groupBy(F.col("src").alias(source)).agg(F.min("dst").alias("entity"), F.count_distinct("dst").alias("n"))
    found = sources.select(source).where(F.col(source).isNotNull()).distinct().join(own, source, "left")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
    return found.select(source, F.when(F.col("n") == 1, F.col("entity")).alias("entity"), fault.alias("fault"))


def query_id(query: str, parameters: dict[str, Column], read: bool = False) -> Column:
    """A write's id is that of its text and parameters, so that repeating it is no other write; every read has one of its own."""
    return F.concat(F.lit("read_"), F.uuid()) if read else stable_id("query", canonical_json({"query": F.lit(query), **parameters}))
