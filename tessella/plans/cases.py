"""Dossiers, audits and cases over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import slug
from tessella.operators import cases as X
from tessella.operators import claims as C
from tessella.operators.checks import naive_target
from tessella.plans import adjudication as A
from tessella.plans import contexts as T
from tessella.plans import table
from tessella.staging import stage

_KEYS = ["subject", "predicate"]


def dossiers(spark, d):
    """Every subject and predicate with its verdict, its values and how many documents they rest on."""
    c = stage(A._claims(spark, d).withColumnRenamed("observation", "claim"), "claims")
    return X.dossiers(A._groups(spark, d), C.answer_groups(c), c.groupBy(*_KEYS).agg(F.count_distinct("source").alias("sources")), _KEYS)


def decision_inputs(spark, d):
    """Logged decisions of two objects: an id of what each was made from."""
    x = table(spark, d, "identity_decision").where("decision_id IS NOT NULL AND size(candidate_source_object_ids) = 2 AND candidate_source_object_ids[0] <> candidate_source_object_ids[1]")
    return x.select("decision_id", X.input_digest({"ids": F.transform("candidate_source_object_ids", lambda i: F.lower(F.trim(i)))}).alias("input")).distinct()


def alignment_audit(spark, d):
    return X.alignment_audit(T._terms(spark, d).withColumn("naive", naive_target(F.col("field"))), "OWNS")


def alignment_review(spark, d):
    """The audit without its answers."""
    return X.blind(alignment_audit(spark, d), ["is_target", "naive_right"], ["system", "object_type", "field", "candidate"]).drop("review_id")


def alignment_reads(spark, d):
    """Decisions about each system's terms, by status: what accepted ones map to, and what holds the others back."""
    a = T.alignment_decisions(spark, d)
    return a.groupBy("system", "status", F.when(F.col("status") == "accepted", F.col("target")).alias("maps_to"), F.when(F.col("status") == "rejected", F.col("constraint")).alias("held_by")).agg(F.count_distinct("field").alias("terms"))


def coverage_reads(spark, d):
    """The slice of every system and extraction method, and how many of its predicates a policy is about."""
    p = table(spark, d, "authority_policy").select(F.lower(F.trim("source_system")).alias("system"), slug(F.col("predicate")).alias("predicate")).distinct()
    c = table(spark, d, "claim").where("predicate IS NOT NULL").select(F.lower(F.trim("source_system")).alias("system"), F.col("extraction_method").alias("object_type"), slug(F.col("predicate")).alias("predicate")).distinct()
    return c.join(p.withColumn("asked", F.lit(1)), ["system", "predicate"], "left").groupBy("system", "object_type").agg(F.count(F.lit(1)).alias("predicates"), F.count("asked").alias("asked"))


def native_mappings(spark, d):
    """Documents' source objects against their native ids: which of them map one to one."""
    docs = table(spark, d, "documents").select("source_object_id", F.concat_ws("|", "source_type", "source_native_id").alias("native")).where(F.col("native").contains("|"))
    return X.one_to_one(docs, "source_object_id", "native").groupBy("fault").agg(F.count(F.lit(1)).alias("mappings"))


def read_epochs(spark, d):
    """The latest day of each case's runs; null where a run was never loaded."""
    return X.read_epoch(table(spark, d, "causal_score_row").where("case_id IS NOT NULL"), "case_id", "loaded_at")


def case_runs(spark, d):
    """Cases of five kinds, each answered by its own read; the last kind has none and fails closed."""
    subjects = table(spark, d, "claim").select(F.col("subject_entity_id").alias("subject")).where("subject IS NOT NULL").distinct()
    kinds = spark.createDataFrame([(k,) for k in ("conflict", "lookup", "evidence", "boundary")], "kind string")
    groups = stage(C.verdicts(A._groups(spark, d)), "verdicts")
    c = A._claims(spark, d)
    reads = {
        "conflict": groups.where("verdict = 'DISPUTED'").select("subject", F.lit("DISPUTED").alias("outcome")),
        "lookup": groups.where("verdict = 'SUPPORTED'").select("subject", F.lit("SUPPORTED").alias("outcome")),
        "evidence": c.join(table(spark, d, "documents").select(F.col("source_object_id").alias("source")).distinct(), "source", "left_semi").select("subject", F.lit("grounded").alias("outcome")),
    }
    return X.run_cases(subjects.crossJoin(F.broadcast(kinds)), reads, "kind", "subject").groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("cases"))


QUERIES = {f.__name__: f for f in (dossiers, decision_inputs, alignment_audit, alignment_review, alignment_reads, coverage_reads, native_mappings, read_epochs, case_runs)}

_SUP = A._GROUPS + f", v AS (SELECT *, {A._PLAIN} AS verdict, {A._REASON} AS reason, {A._ANSWERS} AS answers FROM g)"
_VALUE = f"CASE WHEN coalesce(datatype, 'string') IN ('string', 'text') THEN 'string:' || {A._COLLAPSE.format(x='value')} ELSE datatype || ':' || value END"
_AUDIT = T.SQL["alignment_terms"].replace("SELECT * FROM m", f", w AS (SELECT *, CASE {A._SLUG.format(x='field')} WHEN 'owner' THEN 'OWNS' WHEN 'assignee' THEN 'ASSIGNED_TO' WHEN 'reviewer' THEN 'REVIEWS' ELSE upper({A._SLUG.format(x='field')}) END AS naive FROM m), z AS (SELECT system, object_type, field, candidate, candidate = target AS is_target, naive = target AS naive_right FROM (SELECT *, unnest(CASE WHEN target = 'OWNS' THEN ['OWNS'] ELSE [target, 'OWNS'] END) AS candidate FROM w))")
SQL = {
    "dossiers": _SUP + f", a AS (SELECT subject, predicate, count(DISTINCT {_VALUE}) AS n, min(value) AS label, count(DISTINCT source) AS sources FROM c GROUP BY ALL) SELECT subject, predicate, verdict, reason, answers, CASE WHEN verdict IN ('SUPPORTED', 'DISPUTED') THEN coalesce(n, 0) ELSE 0 END AS answer_values, CASE WHEN verdict IN ('SUPPORTED', 'DISPUTED') THEN label END AS label, coalesce(sources, 0) AS sources, CASE reason WHEN 'identity_missing' THEN 'resolve_identity' WHEN 'claims_disputed' THEN 'resolve_conflict' WHEN 'claim_supported' THEN 'lose_claims' WHEN 'evidence_absent' THEN 'add_evidence' ELSE 'complete_coverage' END AS change FROM v LEFT JOIN a USING (subject, predicate)",
    "decision_inputs": """SELECT DISTINCT decision_id, 'input_' || substr(sha256('input' || chr(0) || '{"ids":' || CAST(to_json(list_sort(list_distinct(list_transform(candidate_source_object_ids, lambda i: lower(trim(i, ' ')))))) AS VARCHAR) || '}'), 1, 24) AS input FROM identity_decision WHERE decision_id IS NOT NULL AND len(candidate_source_object_ids) = 2 AND candidate_source_object_ids[1] <> candidate_source_object_ids[2]""",
    "alignment_audit": _AUDIT + " SELECT * FROM z",
    "alignment_review": _AUDIT + " SELECT system, object_type, field, candidate FROM z",
    "alignment_reads": f"WITH a AS ({T.SQL['alignment_decisions']}) SELECT system, status, CASE WHEN status = 'accepted' THEN target END AS maps_to, CASE WHEN status = 'rejected' THEN \"constraint\" END AS held_by, count(DISTINCT field) AS terms FROM a GROUP BY ALL",
    "coverage_reads": f"WITH p AS (SELECT DISTINCT lower(trim(source_system, ' ')) AS system, {A._SLUG.format(x='predicate')} AS predicate FROM authority_policy), c AS (SELECT DISTINCT lower(trim(source_system, ' ')) AS system, extraction_method AS object_type, {A._SLUG.format(x='predicate')} AS predicate FROM claim WHERE predicate IS NOT NULL) SELECT c.system, object_type, count(*) AS predicates, count(p.predicate) AS asked FROM c LEFT JOIN p ON c.system = p.system AND c.predicate = p.predicate GROUP BY ALL",
    "native_mappings": "WITH p AS (SELECT DISTINCT source_object_id AS o, source_type || '|' || source_native_id AS n FROM documents WHERE source_type IS NOT NULL AND source_native_id IS NOT NULL AND source_object_id IS NOT NULL), q AS (SELECT count(*) OVER (PARTITION BY o) AS a, count(*) OVER (PARTITION BY n) AS b FROM p) SELECT CASE WHEN a > 1 OR b > 1 THEN 'many' END AS fault, count(*) AS mappings FROM q GROUP BY 1",
    "read_epochs": "SELECT case_id, CASE WHEN count(loaded_at) = count(*) THEN max(loaded_at) END AS epoch FROM causal_score_row WHERE case_id IS NOT NULL GROUP BY 1",
    "case_runs": _SUP + """, y AS (SELECT DISTINCT subject_entity_id AS subject FROM claim WHERE subject_entity_id IS NOT NULL), k(kind) AS (VALUES ('conflict'), ('lookup'), ('evidence'), ('boundary')),
      r AS (SELECT DISTINCT 'conflict' AS kind, subject, 'DISPUTED' AS outcome FROM v WHERE verdict = 'DISPUTED' UNION SELECT 'lookup', subject, 'SUPPORTED' FROM v WHERE verdict = 'SUPPORTED' UNION SELECT 'evidence', subject, 'grounded' FROM c WHERE source IN (SELECT source_object_id FROM documents))
      SELECT kind, CASE WHEN kind = 'boundary' THEN 'unsupported_kind' ELSE coalesce(outcome, 'no_result') END AS outcome, count(*) AS cases FROM y CROSS JOIN k LEFT JOIN r USING (kind, subject) GROUP BY ALL""",
}
