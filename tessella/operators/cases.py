"""Dossiers of questions about a subject, audits of decisions, and cases that bring them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import stable_id
from tessella.operators.claims import verdicts


def dossiers(groups: DataFrame, answers: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict, reason, answers, labels, sources, change: a question's verdict with the values that answer it and what they rest on.

    groups: as ``verdicts`` expects. answers: keys, label, claims (one row a value). evidence: keys, sources (how many). Only a supported
    or disputed question shows values. ``change`` is the least that would make the verdict another.
    """
    decided = verdicts(groups)
    shown = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("answer_values"), F.min("label").alias("label"))
    open_ = F.col("verdict").isin("SUPPORTED", "DISPUTED")
    change = F.when(F.col("reason") == "identity_missing", "resolve_identity").when(F.col("reason") == "claims_disputed", "resolve_conflict").when(F.col("reason") == "claim_supported", "lose_claims").when(F.col("reason") == "evidence_absent", "add_evidence").otherwise("complete_coverage")
    joined = decided.join(shown, keys, "left").join(evidence, keys, "left")
    return joined.select(*keys, "verdict", "reason", "answers", F.when(open_, F.coalesce("answer_values", F.lit(0))).otherwise(0).alias("answer_values"), F.when(open_, F.col("label")).alias("label"), F.coalesce("sources", F.lit(0)).alias("sources"), change.alias("change"))


def decision_labels(decisions: DataFrame) -> DataFrame:
    """decisions with ``label`` and ``confidence``: why a pair was decided so, in the order of what counts more.

    Expects status, signals, constraints, and left_namespace and right_namespace (of the accounts). A pending pair has the confidence of names alone.
    """
    has = lambda s: F.coalesce(F.array_contains("signals", s), F.lit(False))
    label = F.when(F.size("constraints") > 0, F.element_at("constraints", 1)).when(has("external_id"), "same_identity_namespace").when(has("email") & (F.col("left_namespace") != F.col("right_namespace")), "cross_source_email_allowed").when(has("handle") & F.col("left_namespace").eqNullSafe(F.col("right_namespace")), "same_account_namespace").when(has("email") | has("handle"), "verified_account_link").otherwise("name_not_unique")
    confidence = F.when(F.col("status") == "rejected", 0.0).when(F.col("status") == "accepted", 1.0).otherwise(0.35)
    return decisions.withColumn("label", label).withColumn("confidence", confidence)


def input_digest(lists: dict[str, Column]) -> Column:
    """An id of what a decision was made from: the lists' values in order, each once, whatever their order was."""
    return stable_id("input", F.to_json(F.struct(*(F.array_sort(F.array_distinct(lists[k])).alias(k) for k in sorted(lists)))))


def alignment_audit(terms: DataFrame, generic: str) -> DataFrame:
    """system, object_type, field, candidate, is_target, naive: each term with its own target and the generic one, each pair once.

    terms: system, object_type, field, surface, target, naive.
    """
    each = F.explode(F.array_distinct(F.array(F.col("target"), F.lit(generic)))).alias("candidate")
    return terms.select("system", "object_type", "field", "surface", "target", "naive", each).select("system", "object_type", "field", "candidate", (F.col("candidate") == F.col("target")).alias("is_target"), (F.col("naive") == F.col("target")).alias("naive_right"))


def blind(audit: DataFrame, hidden: list[str], keys: list[str]) -> DataFrame:
    """An audit without what would give the answer away, with an id for each row to join the answers by again."""
    shown = [c for c in audit.columns if c not in hidden]
    return audit.select(stable_id("review", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("review_id"), *shown)


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, fault of a mapping that must be one to one: ``many`` where either side has several partners."""
    p = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    many = lambda k: p.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_{k}"))
    return p.join(many(left), left).join(many(right), right).select(left, right, F.when((F.col(f"n_{left}") > 1) | (F.col(f"n_{right}") > 1), "many").alias("fault"))


def read_epoch(segments: DataFrame, by: str, epoch: str) -> DataFrame:
    """by, epoch: the latest read epoch of several segments; null where any segment lacks one."""
    return segments.groupBy(by).agg(F.when(F.count(epoch) == F.count(F.lit(1)), F.max(epoch)).alias("epoch"))


def run_cases(cases: DataFrame, reads: dict[str, DataFrame], kind: str, key: str) -> DataFrame:
    """cases with ``outcome``: each kind of case is answered by its own read (key, outcome), all in one plan.

    A case whose kind has no read, or whose read finds nothing, fails closed: ``unsupported_kind`` or ``no_result``.
    """
    found = None
    for name, read in reads.items():
        one = read.select(F.lit(name).alias(kind), key, "outcome").groupBy(kind, key).agg(F.min("outcome").alias("outcome"))
        found = one if found is None else found.unionByName(one)
    known = F.col(kind).isin(*reads)
    return cases.join(found, [kind, key], "left").withColumn("outcome", F.when(~F.coalesce(known, F.lit(False)), "unsupported_kind").otherwise(F.coalesce("outcome", F.lit("no_result"))))
