"""Identity resolution: signals, constraints, decisions, entities, vetoes and reversals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import pair_key, stable_id
from tessella.operators.components import connected_components

#: Kinds of signals in order, with the confidence each gives; names alone never accept.
KINDS = ("external_id", "email", "handle", "name")
WEAK, NAME_WEIGHT, MOST_PENDING = "name", 0.35, 0.89


def identity_keys(observations: DataFrame) -> DataFrame:
    """object, kind, value, key of observations (object, kind, namespace, value): emails and names match in any namespace, others in their own."""
    value = F.lower(F.trim("value"))
    anywhere = F.col("kind").isin("email", "name")
    scope = F.when(anywhere, F.lit("global")).otherwise(F.lower(F.trim("namespace")))
    fine = observations.where(F.col("object").isNotNull() & F.col("kind").isin(*KINDS) & (value != ""))
    return fine.select("object", "kind", scope.alias("scope"), value.alias("value"), F.concat_ws(":", "kind", scope, value).alias("key")).distinct()


def signals(keys: DataFrame, most_shared: int | None = None) -> DataFrame:
    """left, right, kind, value: for each pair of objects that share keys one signal a kind, with the least shared value.

    Only equal keys meet, which loses no pair, as every signal is an equality. ``most_shared`` leaves out keys that
    more objects share (say, a switchboard); None keeps all.
    """
    have = keys
    if most_shared is not None:
        few = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_shared).select("key")
        have = keys.join(few, "key")
    other = have.select(F.col("object").alias("right"), "key")
    pairs = have.withColumnRenamed("object", "left").join(other, "key").where("left < right")
    return pairs.groupBy("left", "right", "kind").agg(F.min("value").alias("value"))


def constraints(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """left, right, constraint: kinds and namespaces in which both objects have values and share none."""
    held = keys.where(F.col("kind").isin("email", "external_id")).groupBy("object", "kind", "scope").agg(F.collect_set("value").alias("values"))
    left = held.select(F.col("object").alias("left"), "kind", "scope", F.col("values").alias("lv"))
    right = held.select(F.col("object").alias("right"), "kind", "scope", F.col("values").alias("rv"))
    both = pairs.select("left", "right").distinct().join(left, "left").join(right, ["right", "kind", "scope"])
    name = F.when(F.col("kind") == "email", F.lit("email_conflict")).otherwise(F.concat(F.lit("identifier_conflict:"), "scope"))
    return both.where(~F.arrays_overlap("lv", "rv")).select("left", "right", name.alias("constraint"))


def decide(found: DataFrame, against: DataFrame) -> DataFrame:
    """left, right, status, confidence, signals, constraints: a constraint rejects, a verified signal accepts, names alone are pending."""
    s = found.groupBy("left", "right").agg(F.array_sort(F.collect_set("kind")).alias("signals"), F.avg(F.when(F.col("kind") == WEAK, NAME_WEIGHT).otherwise(1.0)).alias("weight"), F.max(F.col("kind") != WEAK).alias("verified"))
    c = against.groupBy("left", "right").agg(F.array_sort(F.collect_set("constraint")).alias("constraints"))
    both = s.join(c, ["left", "right"], "left").withColumn("constraints", F.coalesce("constraints", F.array().cast("array<string>")))
    status = F.when(F.size("constraints") > 0, "rejected").when(F.col("verified"), "accepted").otherwise("pending")
    confidence = F.when(F.col("status") == "rejected", 0.0).when(F.col("status") == "accepted", 1.0).otherwise(F.least(F.lit(MOST_PENDING), "weight"))
    return both.withColumn("status", status).withColumn("confidence", confidence).select("left", "right", "status", "confidence", "signals", "constraints")


def entities(decisions: DataFrame, objects: DataFrame) -> DataFrame:
    """object, entity: components over accepted pairs, singletons too; an entity's id is made of its least object."""
    accepted = decisions.where("status = 'accepted'")
    found = connected_components(accepted, "left", "right", objects.select(F.col("object").alias("vertex")))
    return found.select(F.col("vertex").alias("object"), stable_id("entity", F.col("component")).alias("entity"))


def vetoed_merge(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """The accepted decisions of which each is applied in order of (left, right), unless its merged cluster would hold two external ids of one namespace.

    left, right, status (accepted or rejected). A component that holds one external id of each namespace at most can
    veto nothing and is accepted as a whole. Order matters inside the others and nowhere else, so each of them is worked
    through by itself, with one entry for each of its objects in memory.
    """
    accepted = decisions.where("status = 'accepted'").select("left", "right")
    component = connected_components(accepted, "left", "right")
    ids = keys.where("kind = 'external_id'").groupBy(F.col("object").alias("vertex")).agg(F.collect_list(F.concat_ws("\x1f", "scope", "value")).alias("ids"))
    placed = component.join(ids, "vertex", "left")
    several = placed.select("component", F.explode("ids").alias("id")).groupBy("component", F.split("id", "\x1f")[0].alias("scope")).agg(F.count_distinct("id").alias("n")).where("n > 1").select("component").distinct()
    edges = accepted.join(placed.select(F.col("vertex").alias("left"), "component", F.col("ids").alias("li")), "left").join(placed.select(F.col("vertex").alias("right"), F.col("ids").alias("ri")), "right")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        held: dict[str, dict[str, set[str]]] = {}

        def root(x: str) -> str:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def enter(x: str, ids) -> None:
            if x not in parent:
                parent[x], held[x] = x, {}
                for scope, _, value in (i.partition("\x1f") for i in (ids if ids is not None else ())):
                    held[x].setdefault(scope, set()).add(value)

        status = []
        ordered = pdf.sort_values(["left", "right"])
        for r in ordered.itertuples(index=False):
            enter(r.left, r.li)
            enter(r.right, r.ri)
            a, b = root(r.left), root(r.right)
            if a != b and any(len(held[a].get(s, set()) | v) > 1 for s, v in held[b].items()):
                status.append("rejected")
                continue
            status.append("accepted")
            if a != b:
                parent[max(a, b)] = min(a, b)
                for s, v in held[max(a, b)].items():
                    held[min(a, b)].setdefault(s, set()).update(v)
        return ordered[["left", "right"]].assign(status=status)

    clean = edges.join(several, "component", "left_anti").select("left", "right", F.lit("accepted").alias("status"))
    return clean.unionByName(edges.join(several, "component", "left_semi").groupBy("component").applyInPandas(merge, "left string, right string, status string"))


def active_decisions(decisions: DataFrame) -> DataFrame:
    """Of (decision, left, right, status, at) the last decision of each pair in either orientation; reversed ones undo and are left out."""
    order = Window.partitionBy(pair_key(F.col("left"), F.col("right"))).orderBy(F.col("at").desc_nulls_last(), F.col("decision").desc())
    return decisions.withColumn("__k", F.row_number().over(order)).where("__k = 1 AND status <> 'reversed'").drop("__k")


def review_order(decisions: DataFrame, each: int) -> DataFrame:
    """The first ``each`` pairs of every status, without what would give the answer away: a review set."""
    k = F.row_number().over(Window.partitionBy("status").orderBy("left", "right"))
    return decisions.withColumn("place", k).where(F.col("place") <= each).select("left", "right", "status", "place")
