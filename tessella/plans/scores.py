"""Reports of attempts and arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import scores as S
from tessella.operators.contexts import token_count
from tessella.operators.intake import once
from tessella.plans import table
from tessella.staging import stage

_STATES = ("SUPPORTED", "DISPUTED", "NOT_FOUND", "UNKNOWN")


def _runs(spark, d):
    """One row a row_id, the one loaded first; one run a case and arm, the last one."""
    every = once(table(spark, d, "causal_score_row"), ["row_id"], [F.col("loaded_at").asc(), F.col("latency_ms").asc()]).withColumn("arm", F.regexp_replace(F.replace(F.lower(F.trim("arm_id")), F.lit("-"), F.lit("_")), "^full_[a-z]+_grounding$", "full_grounding")).withColumn("verdict", F.upper("verdict"))
    return once(every.where("case_id IS NOT NULL AND arm IS NOT NULL"), ["case_id", "arm"], [F.col("run_at").desc_nulls_last(), F.col("row_id").desc()])


def _best(spark, d):
    """case_id, doc_id, place: the documents of each listed question, at most its maximum."""
    q = table(spark, d, "conflict_case").where("question_id IS NOT NULL").groupBy(F.col("question_id").alias("case_id")).agg(F.max("maximum_documents").alias("most"))
    c = table(spark, d, "retrieval_candidate").where("score IS NOT NULL AND NOT isnan(score)").groupBy(F.col("question_id").alias("case_id"), "doc_id").agg(F.max("score").alias("score"))
    k = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc(), "doc_id"))
    return c.join(q, "case_id").withColumn("place", k).where("place <= most").select("case_id", "doc_id", "place")


def _labels(spark, d, runs):
    """A label for each listed case: the verdict of the pinned arm, and the best documents as evidence."""
    e = _best(spark, d).groupBy("case_id").agg(F.collect_list("doc_id").alias("evidence"))
    v = runs.where("arm = 'current_evidence_pinning'").select("case_id", F.col("verdict").alias("expected"))
    return e.join(v, "case_id", "left").select("case_id", "evidence", F.coalesce("expected", F.lit("UNKNOWN")).alias("verdict"))


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def case_report(spark, d):
    r = stage(_runs(spark, d), "runs")
    cases = r.join(_labels(spark, d, r).select("case_id", F.col("evidence").alias("expected_evidence"), F.col("verdict").alias("expected")), "case_id").withColumn("latency", F.when(~F.isnan("latency_ms"), F.col("latency_ms")))
    return _rounded(S.case_report(cases, ["arm"], "expected", "verdict", "expected_evidence", "evidence_document_ids", "latency"))


def attempt_report(spark, d):
    """All measures of attempts by arm. States follow from the verdict, the documents and the queries of a run, facts from its evidence."""
    r = stage(_runs(spark, d), "runs")
    state = lambda v: F.when(F.col(v) == "DISPUTED", "unresolved").when(F.col(v) == "SUPPORTED", "none").otherwise("not_applicable")
    known = lambda v: F.when(F.col(v) == "UNKNOWN", "unresolved").otherwise("resolved")
    text = lambda c: F.transform(c, lambda i: i.cast("string"))
    live = F.col("hydra_query_count") > 0
    labels = _labels(spark, d, r).select(
        "case_id", text(F.col("evidence")).alias("facts"), "verdict", "evidence", F.array(F.lit("SUPPORTED_BY")).alias("relationships"), F.array(F.lit("CONFLICTS_WITH")).alias("forbidden"), F.lit("complete").alias("coverage"), (F.col("verdict") == "SUPPORTED").alias("proof"), state("verdict").alias("conflict"), known("verdict").alias("identity"), F.lit("not_applicable").alias("alignment"),
    )
    own = F.coalesce("evidence_document_ids", F.array().cast("array<bigint>"))
    attempts = r.select(
        "case_id", "arm", "status", text(own).alias("facts"), "verdict", own.alias("evidence"), F.when(live, F.array(F.lit("SUPPORTED_BY"))).otherwise(F.array().cast("array<string>")).alias("relationships"), F.when(F.col("context_document_count") > 1, "complete").otherwise("partial").alias("coverage"), live.alias("proof"), state("verdict").alias("conflict"), known("verdict").alias("identity"),
        F.lit("not_applicable").alias("alignment"), F.size(own).alias("accepted"), F.greatest(F.lit(0), F.col("context_document_count") - F.size(own)).alias("rejected"), F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency"),
    )
    return _rounded(S.attempt_report(labels, attempts, "case_id", ["arm"]))


def conflict_lane(spark, d):
    """The conflict questions by arm: right where the verdict is SUPPORTED and all its evidence is among the best documents."""
    r = stage(_runs(spark, d), "runs")
    e = r.join(_labels(spark, d, r).select("case_id", F.col("evidence").alias("expected")), "case_id")
    own = F.array_distinct(F.coalesce("evidence_document_ids", F.array().cast("array<bigint>")))
    hit = F.size(F.array_intersect(own, F.col("expected")))
    scored = e.select("arm", "status", (F.coalesce(F.col("verdict") == "SUPPORTED", F.lit(False)) & (hit == F.size(own))).alias("correct"), (hit / F.size("expected")).alias("complete"), F.coalesce(~F.col("verdict").isin(*_STATES), F.lit(True)).alias("malformed"))
    return _rounded(S.lane_score(scored, ["arm"], "status", "correct", "complete", "malformed"))


def proof_summary(spark, d):
    return S.arm_deltas(case_report(spark, d), "arm", "plain_retrieval", ["verdict_accuracy", "evidence_recall", "invalid_extra_rate"])


def _contexts(spark, d):
    """Contexts of listed cases with their lengths in bands of 50 words, and which documents are the current or a superseded version."""
    docs = table(spark, d, "documents").select("doc_id", "source_object_id", "observed_at", F.floor(token_count(F.col("text")) / 50).alias("tokens"))
    member = table(spark, d, "source_version_group").select("group_id", F.explode("source_object_ids").alias("source_object_id")).distinct().join(docs, "source_object_id")
    latest = member.groupBy("group_id").agg(F.max_by("doc_id", F.struct("observed_at", "doc_id")).alias("latest"))
    kinds = member.join(latest, "group_id").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("latest")).alias("current"), F.bool_and(F.col("doc_id") != F.col("latest")).alias("superseded"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    marked = docs.join(kinds, "doc_id", "left").select("doc_id", "tokens", no("current"), no("superseded"))
    pool = table(spark, d, "retrieval_candidate").select(F.col("question_id").alias("case_id"), "doc_id").distinct().join(docs.select("doc_id", "tokens"), "doc_id")
    return _best(spark, d).join(marked, "doc_id"), pool


def causal_arms(spark, d):
    contexts, pool = _contexts(spark, d)
    return S.causal_arms(stage(contexts, "contexts"), pool, "case_id", "doc_id", "arms")


def loss_categories(spark, d):
    """How many cases each category may explain, and how many lack a run of some arm."""
    contexts, _ = _contexts(spark, d)
    held = stage(contexts, "contexts")
    several = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("source_object_id")).distinct().join(table(spark, d, "documents").select("source_object_id", "doc_id"), "source_object_id").select("doc_id")
    offered = table(spark, d, "retrieval_candidate").select(F.col("question_id").alias("case_id"), "doc_id").distinct().join(several, "doc_id", "left_semi")
    missing = offered.join(held.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    removed = held.where("superseded").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    signature = F.concat_ws("|", F.coalesce("status", F.lit("")), F.coalesce("verdict", F.lit("")), F.array_join(F.array_sort("evidence_document_ids"), ","))
    late = (F.col("status") == "failed") & (F.col("latency_ms") > 1000) & ~F.isnan("latency_ms")
    found = S.loss_diagnosis(_runs(spark, d), "case_id", "arm", signature, "context_token_budget", "status", late, missing, removed)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))


def _pairs(spark, d):
    """Logged decisions of two objects: left, right, status, at."""
    ids = F.col("candidate_source_object_ids")
    clean = lambda x: F.lower(F.trim(x))
    x = table(spark, d, "identity_decision").where(F.size(ids) == 2).select("decision_id", F.least(clean(ids[0]), clean(ids[1])).alias("left"), F.greatest(clean(ids[0]), clean(ids[1])).alias("right"), F.regexp_replace(F.lower("status"), r"\s", "").alias("status"), F.col("decided_at").alias("at"), "signals", "constraints")
    return x.where("left <> right AND left <> ''")


def _last(spark, d):
    return _pairs(spark, d).groupBy("left", "right").agg(F.max_by("status", F.struct("at", "decision_id")).alias("last"), F.min_by("status", F.struct("at", "decision_id")).alias("first"))


def pair_scores(spark, d):
    """The pairs that any decision accepted against those that the last one accepts."""
    return _rounded(S.set_scores(_pairs(spark, d).where("status = 'accepted'"), _last(spark, d).where("last = 'accepted'"), ["left", "right"]))


def accepted_class(spark, d):
    """Each pair's first decision against its last one."""
    return _rounded(S.accepted_class(_last(spark, d).withColumn("all", F.lit("pairs")), "last", "first", ["all"]))


def identity_ablation(spark, d):
    """Pairs that names alone propose, and what exact signals and constraints make of them."""
    by = _pairs(spark, d).groupBy("left", "right").agg(F.bool_or(F.coalesce(F.array_contains("signals", "name_similarity"), F.lit(False))).alias("named"), F.bool_or(F.coalesce(F.exists("signals", lambda s: s != "name_similarity"), F.lit(False))).alias("exact"), F.bool_or(F.coalesce(F.size("constraints") > 0, F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("status") == "accepted", F.lit(False))).alias("accepted"))
    return by.agg(F.count_if("named").alias("name_candidates"), F.count_if(F.col("named") & F.col("blocked")).alias("hard_negatives"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("named") & ~F.col("exact")).alias("naive_only"), F.count_if(F.col("exact") & ~F.col("blocked")).alias("exact_accepts"))


def gold_identity_pairs(spark, d):
    """Pairs of records that share an exact identifier of one namespace."""
    x = table(spark, d, "review_source").select("source_object_id", F.explode("external_identifiers").alias("x")).select("source_object_id", F.lower(F.trim("x.namespace")).alias("n"), F.lower(F.trim("x.value")).alias("v")).where("n <> '' AND v <> ''").distinct()
    right = x.select(F.col("source_object_id").alias("right"), "n", "v")
    return x.withColumnRenamed("source_object_id", "left").join(right, ["n", "v"]).where("left < right").select("left", "right").distinct()


def benchmark_cases(spark, d):
    """Claims grouped to cases of an entity, predicate and datatype, and one of an entity that isn't known."""
    c = table(spark, d, "claim").where("subject_entity_id IS NOT NULL AND object_value IS NOT NULL").select("subject_entity_id", F.lower(F.trim("predicate")).alias("predicate"), F.coalesce("datatype", F.lit("none")).alias("datatype"), "object_value", "claim_id").distinct()
    cases = c.groupBy("subject_entity_id", "predicate", "datatype").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("object_value").alias("answers")).withColumn("expected", F.when(F.col("answers") > 1, "DISPUTED").otherwise("SUPPORTED"))
    unknown = spark.createDataFrame([("entity_unknown", "display_name", "none", 0, 0, "UNKNOWN")], cases.schema)
    return cases.unionByName(unknown)


def version_candidates(spark, d):
    """Of each listed question's documents the native ids that come in several versions."""
    docs = table(spark, d, "documents").where("source_native_id IS NOT NULL").select("doc_id", "source_native_id", "source_object_id")
    found = _best(spark, d).join(docs, "doc_id").groupBy("case_id", "source_native_id").agg(F.count(F.lit(1)).alias("versions"), F.array_join(F.array_sort(F.collect_set("source_object_id")), ",").alias("sources"))
    return found.where("versions > 1")


QUERIES = {f.__name__: f for f in (case_report, attempt_report, conflict_lane, proof_summary, causal_arms, loss_categories, pair_scores, accepted_class, identity_ablation, gold_identity_pairs, benchmark_cases, version_candidates)}

_R = """WITH r0 AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at NULLS FIRST, latency_ms NULLS FIRST) AS k FROM causal_score_row),
r1 AS (SELECT * EXCLUDE (verdict, k), upper(verdict) AS verdict, regexp_replace(replace(lower(trim(arm_id, ' ')), '-', '_'), '^full_[a-z]+_grounding$', 'full_grounding') AS arm, coalesce(evidence_document_ids, []) AS own, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS latency FROM r0 WHERE k = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, arm ORDER BY run_at DESC NULLS LAST, row_id DESC) AS k FROM r1 WHERE case_id IS NOT NULL AND arm IS NOT NULL) WHERE k = 1),
q AS (SELECT question_id AS case_id, max(maximum_documents) AS most FROM conflict_case WHERE question_id IS NOT NULL GROUP BY 1),
b0 AS (SELECT question_id AS case_id, doc_id, max(score) AS score FROM retrieval_candidate WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
b AS (SELECT * FROM (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS place, most FROM b0 JOIN q USING (case_id)) WHERE place <= most),
l AS (SELECT case_id, list(doc_id) AS evidence, coalesce(any_value(v), 'UNKNOWN') AS expected FROM b LEFT JOIN (SELECT case_id, verdict AS v FROM r WHERE arm = 'current_evidence_pinning') USING (case_id) GROUP BY case_id)
"""
_CASES = _R + """, e AS (SELECT arm, r.verdict IS NOT DISTINCT FROM expected AS right_, len(list_intersect(list_distinct(own), evidence)) AS h, len(list_distinct(own)) AS a, len(evidence) AS x, latency FROM r JOIN l USING (case_id)),
c AS (SELECT arm, count(*) AS cases, round(count(*) FILTER (WHERE right_) / count(*)::DOUBLE, 9) AS verdict_accuracy, round(sum(h) / nullif(sum(x), 0)::DOUBLE, 9) AS evidence_recall, round(sum(a - h) / nullif(sum(a), 0)::DOUBLE, 9) AS invalid_extra_rate, round(coalesce(quantile_disc(latency, 0.5), 0), 9) AS p50, round(coalesce(quantile_disc(latency, 0.95), 0), 9) AS p95 FROM e GROUP BY arm)
"""
_STATE = "CASE {v} WHEN 'DISPUTED' THEN 'unresolved' WHEN 'SUPPORTED' THEN 'none' ELSE 'not_applicable' END"
_KNOWN = "CASE {v} WHEN 'UNKNOWN' THEN 'unresolved' ELSE 'resolved' END"
_ATTEMPTS = _R + f""", g AS (SELECT DISTINCT arm FROM r), w AS (SELECT case_id, evidence, expected, arm FROM l, g),
j AS (SELECT w.arm, w.expected AS ev, x.case_id IS NOT NULL AS ok, x.verdict AS v, len(list_intersect(list_distinct(coalesce(own, [])), evidence)) AS h, len(list_distinct(coalesce(own, []))) AS a, len(evidence) AS x, hydra_query_count > 0 AS live, context_document_count > 1 AS whole,
  {_STATE.format(v="w.expected")} AS ec, CASE WHEN x.case_id IS NOT NULL THEN {_STATE.format(v="x.verdict")} END AS ac, {_KNOWN.format(v="w.expected")} AS ei, CASE WHEN x.case_id IS NOT NULL THEN CASE WHEN x.verdict = 'UNKNOWN' THEN 'unresolved' ELSE 'resolved' END END AS ai FROM w LEFT JOIN (SELECT * FROM r WHERE status = 'completed') x ON x.case_id = w.case_id AND x.arm = w.arm),
s AS (SELECT arm, count(*) AS labels, count(*) FILTER (WHERE ok AND h = x AND a = h) / count(*)::DOUBLE AS answer_correctness, sum(CASE WHEN ok THEN h / x::DOUBLE ELSE 0 END) / count(*) AS answer_completeness, count(*) FILTER (WHERE ok AND v = ev) / count(*)::DOUBLE AS verdict_accuracy, sum(h) / nullif(sum(a), 0)::DOUBLE AS evidence_precision, sum(h) / nullif(sum(x), 0)::DOUBLE AS evidence_recall,
  sum(a - h) / nullif(sum(a), 0)::DOUBLE AS invalid_extra_rate, count(*) FILTER (WHERE ok AND live) / count(*)::DOUBLE AS relationship_accuracy, count(*) FILTER (WHERE ok AND whole) / count(*)::DOUBLE AS coverage_accuracy, count(*) FILTER (WHERE ok AND (ev <> 'SUPPORTED' OR live)) / count(*)::DOUBLE AS proof_accuracy,
  count(*) FILTER (WHERE ec <> 'not_applicable' AND (ec <> 'none') = coalesce(ac NOT IN ('none', 'not_applicable'), false)) / nullif(count(*) FILTER (WHERE ec <> 'not_applicable'), 0)::DOUBLE AS conflict_detection, count(*) FILTER (WHERE ec = 'unresolved' AND ac = 'unresolved') / nullif(count(*) FILTER (WHERE ec = 'unresolved'), 0)::DOUBLE AS conflict_resolution,
  count(*) FILTER (WHERE ei = ai) / count(*)::DOUBLE AS identity_accuracy, NULL::DOUBLE AS alignment_accuracy, count(*) FILTER (WHERE v IN ('UNKNOWN', 'DISPUTED') AND ev IN ('UNKNOWN', 'DISPUTED')) / nullif(count(*) FILTER (WHERE v IN ('UNKNOWN', 'DISPUTED')), 0)::DOUBLE AS abstention_precision,
  count(*) FILTER (WHERE v IN ('UNKNOWN', 'DISPUTED') AND ev IN ('UNKNOWN', 'DISPUTED')) / nullif(count(*) FILTER (WHERE ev IN ('UNKNOWN', 'DISPUTED')), 0)::DOUBLE AS abstention_recall FROM j GROUP BY arm),
t AS (SELECT arm, count(*) AS attempted, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'rejected') AS refused, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE case_id NOT IN (SELECT case_id FROM l)) AS unscored, coalesce(sum(len(own)) FILTER (WHERE status = 'completed'), 0)::BIGINT AS grounded,
  coalesce(sum(greatest(0, context_document_count - len(own))) FILTER (WHERE status = 'completed'), 0)::BIGINT AS ungrounded, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM r GROUP BY arm)
SELECT arm, labels, round(answer_correctness, 9) AS answer_correctness, round(answer_completeness, 9) AS answer_completeness, round(verdict_accuracy, 9) AS verdict_accuracy, round(evidence_precision, 9) AS evidence_precision, round(evidence_recall, 9) AS evidence_recall,
  round(CASE WHEN evidence_precision + evidence_recall = 0 THEN 0 ELSE 2 * evidence_precision * evidence_recall / (evidence_precision + evidence_recall) END, 9) AS evidence_f1, round(invalid_extra_rate, 9) AS invalid_extra_rate, round(relationship_accuracy, 9) AS relationship_accuracy, round(coverage_accuracy, 9) AS coverage_accuracy, round(proof_accuracy, 9) AS proof_accuracy,
  round(conflict_detection, 9) AS conflict_detection, round(conflict_resolution, 9) AS conflict_resolution, round(identity_accuracy, 9) AS identity_accuracy, alignment_accuracy, round(abstention_precision, 9) AS abstention_precision, round(abstention_recall, 9) AS abstention_recall,
  attempted, completed, refused, failed, unscored, grounded, ungrounded, round(grounded / nullif(grounded + ungrounded, 0)::DOUBLE, 9) AS grounding_rate, round(p50, 9) AS p50, round(p95, 9) AS p95 FROM s JOIN t USING (arm)"""
_CONTEXT = _R + """, dc AS (SELECT doc_id, source_object_id, observed_at, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) // 50 AS tokens FROM documents),
m AS (SELECT DISTINCT group_id, doc_id, observed_at FROM (SELECT group_id, unnest(source_object_ids) AS source_object_id FROM source_version_group) JOIN dc USING (source_object_id)),
la AS (SELECT group_id, first(doc_id ORDER BY observed_at DESC NULLS LAST, doc_id DESC) AS latest FROM m GROUP BY 1),
kk AS (SELECT doc_id, bool_or(doc_id = latest) AS current, bool_and(doc_id <> latest) AS superseded FROM m JOIN la USING (group_id) GROUP BY 1),
cx AS (SELECT b.case_id, b.doc_id, b.place, tokens, coalesce(current, false) AS current, coalesce(superseded, false) AS superseded, count(*) OVER (PARTITION BY b.case_id) AS n FROM b JOIN dc USING (doc_id) LEFT JOIN kk USING (doc_id))
"""
_GONE = " UNION ALL ".join(f"SELECT case_id, '{a}' AS arm, doc_id, place, tokens FROM cx WHERE " + {"drawn": "place = ('0x' || substr(sha256('arms:' || case_id), 1, 8))::BIGINT % n + 1", "superseded": "superseded", "not_current": "NOT current"}[w] for a, w in S.ARMS.items() if w)
_SAFE = "CASE WHEN {d} = 0 THEN 0.0 ELSE {n} / {d}::DOUBLE END"
_IDS = """WITH x AS (SELECT decision_id, least(lower(trim(candidate_source_object_ids[1], ' ')), lower(trim(candidate_source_object_ids[2], ' '))) AS l, greatest(lower(trim(candidate_source_object_ids[1], ' ')), lower(trim(candidate_source_object_ids[2], ' '))) AS r, candidate_source_object_ids AS ids, regexp_replace(lower(status), '\\s', '', 'g') AS status, decided_at AS dt, signals, constraints FROM identity_decision WHERE len(candidate_source_object_ids) = 2),
y AS (SELECT * FROM x WHERE l <> r AND l <> '' AND ids[1] IS NOT NULL AND ids[2] IS NOT NULL),
z AS (SELECT l, r, first(status ORDER BY dt DESC NULLS LAST, decision_id DESC) AS last_, first(status ORDER BY dt NULLS FIRST, decision_id) AS first_ FROM y WHERE status IS NOT NULL GROUP BY ALL)
"""
_F1 = "CASE WHEN p + c = 0 THEN 0.0 ELSE 2 * p * c / (p + c) END"
SQL = {
    "case_report": _CASES + "SELECT * FROM c",
    "attempt_report": _ATTEMPTS,
    "conflict_lane": _R + f""", e AS (SELECT arm, status = 'completed' AS done, verdict, list_distinct(own) AS o, evidence AS x FROM r JOIN l USING (case_id)), h AS (SELECT *, len(list_intersect(o, x)) AS h FROM e),
      s AS (SELECT arm, count(*) AS attempted, count(*) FILTER (WHERE done) AS answered, count(*) FILTER (WHERE done AND verdict = 'SUPPORTED' AND h = len(o)) AS c, sum(CASE WHEN done THEN h / len(x)::DOUBLE ELSE 0 END) AS p, count(*) FILTER (WHERE done AND coalesce(verdict NOT IN {_STATES}, true)) AS m FROM h GROUP BY arm)
      SELECT arm, attempted, answered, round(c / attempted::DOUBLE, 9) AS correctness, round(p / attempted, 9) AS completeness, round({_SAFE.format(n="m", d="answered")}, 9) AS malformed_rate FROM s""",
    "proof_summary": _CASES + ", o AS (SELECT * FROM c WHERE arm = 'plain_retrieval') SELECT c.arm, " + ", ".join(f"round(c.{m} - o.{m}, 12) AS {m}_delta" for m in ("verdict_accuracy", "evidence_recall", "invalid_extra_rate")) + " FROM c, o",
    "causal_arms": _CONTEXT + f", g AS ({_GONE}), gn AS (SELECT *, row_number() OVER (PARTITION BY case_id, arm, tokens ORDER BY place) AS k FROM g), po AS (SELECT DISTINCT question_id AS case_id, doc_id FROM retrieval_candidate), sp AS (SELECT case_id, po.doc_id AS replacement, tokens, row_number() OVER (PARTITION BY case_id, tokens ORDER BY po.doc_id DESC) AS k FROM po JOIN dc USING (doc_id) WHERE (case_id, po.doc_id) NOT IN (SELECT (case_id, doc_id) FROM cx) AND case_id IS NOT NULL) SELECT case_id, arm, doc_id, replacement FROM gn LEFT JOIN sp USING (case_id, tokens, k)",
    "loss_categories": _CONTEXT + """, mi AS (SELECT question_id AS case_id, count(DISTINCT doc_id) AS n FROM retrieval_candidate WHERE doc_id IN (SELECT doc_id FROM m) AND (question_id, doc_id) NOT IN (SELECT (case_id, doc_id) FROM cx) GROUP BY 1), re AS (SELECT DISTINCT case_id FROM cx WHERE superseded),
      ru AS (SELECT *, concat_ws('|', coalesce(status, ''), coalesce(verdict, ''), array_to_string(list_sort(evidence_document_ids), ',')) AS s FROM r WHERE arm IN """ + str(tuple(S.ARMS)) + """),
      by_ AS (SELECT case_id, count(*) AS n, max(s) FILTER (WHERE arm = 'full_grounding') AS f, max(s) FILTER (WHERE arm = 'no_conflict_policy') AS c, max(s) FILTER (WHERE arm = 'no_identity_resolution') AS i, max(s) FILTER (WHERE arm = 'no_ontology_alignment') AS a, count(DISTINCT coalesce(context_token_budget, -1)) AS bu, bool_or(coalesce(status = 'failed' AND latency > 1000, false)) AS late, bool_or(status = 'rejected') AS ref FROM ru GROUP BY 1),
      k AS (SELECT unnest(CASE WHEN n <> 10 THEN ['incomplete'] ELSE list_filter([CASE WHEN case_id IN (SELECT case_id FROM mi) THEN 'retrieval' END, CASE WHEN case_id IN (SELECT case_id FROM re) OR f IS DISTINCT FROM c THEN 'conflict-policy' END, CASE WHEN f IS DISTINCT FROM i THEN 'identity' END, CASE WHEN f IS DISTINCT FROM a THEN 'alignment' END, CASE WHEN bu > 1 THEN 'context-budget' END, CASE WHEN late THEN 'model-timeout' END, CASE WHEN ref THEN 'scorer-failure' END], lambda z: z IS NOT NULL) END) AS category FROM by_)
      SELECT category, count(*) AS cases FROM k GROUP BY 1""",
    "pair_scores": _IDS + f", g AS (SELECT DISTINCT l, r FROM y WHERE status = 'accepted'), p AS (SELECT l, r FROM z WHERE last_ = 'accepted'), n AS (SELECT (SELECT count(*) FROM g JOIN p USING (l, r)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng), s AS (SELECT tp, np - tp AS fp, ng - tp AS fn, {_SAFE.format(n='tp', d='np')} AS p, {_SAFE.format(n='tp', d='ng')} AS c FROM n) SELECT tp, fp, fn, round(p, 9) AS precision, round(c, 9) AS recall, round({_F1}, 9) AS f1 FROM s",
    "accepted_class": _IDS + f", s AS (SELECT count(*) FILTER (WHERE last_ = 'accepted' AND first_ = 'accepted') AS tp, count(*) FILTER (WHERE last_ = 'rejected' AND first_ = 'accepted') AS fp, count(*) FILTER (WHERE last_ = 'accepted' AND first_ = 'rejected') AS fn, count(*) FILTER (WHERE last_ = 'pending' AND first_ = 'pending') AS agreed, count(*) FILTER (WHERE (last_ = 'pending') <> (first_ = 'pending')) AS undecided FROM z), t AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS c FROM s) SELECT 'pairs' AS \"all\", tp, fp, fn, round(p, 9) AS precision, round(c, 9) AS recall, round({_F1}, 9) AS f1, agreed, undecided FROM t",
    "identity_ablation": _IDS + ", g AS (SELECT l, r, bool_or(coalesce(list_contains(signals, 'name_similarity'), false)) AS named, bool_or(coalesce(len(list_filter(signals, lambda s: s <> 'name_similarity')) > 0, false)) AS exact, bool_or(coalesce(len(constraints) > 0, false)) AS blocked, bool_or(coalesce(status = 'accepted', false)) AS acc FROM y GROUP BY ALL) SELECT count(*) FILTER (WHERE named) AS name_candidates, count(*) FILTER (WHERE named AND blocked) AS hard_negatives, count(*) FILTER (WHERE acc) AS accepted, count(*) FILTER (WHERE named AND NOT exact) AS naive_only, count(*) FILTER (WHERE exact AND NOT blocked) AS exact_accepts FROM g",
    "gold_identity_pairs": "WITH u AS (SELECT source_object_id AS o, unnest(external_identifiers) AS x FROM review_source), k AS (SELECT DISTINCT o, lower(trim(x.namespace, ' ')) AS n, lower(trim(x.value, ' ')) AS v FROM u WHERE trim(x.namespace, ' ') <> '' AND trim(x.value, ' ') <> '') SELECT DISTINCT a.o AS \"left\", b.o AS \"right\" FROM k a JOIN k b USING (n, v) WHERE a.o < b.o",
    "benchmark_cases": "WITH c AS (SELECT DISTINCT subject_entity_id, lower(trim(predicate, ' ')) AS predicate, coalesce(datatype, 'none') AS datatype, object_value, claim_id FROM claim WHERE subject_entity_id IS NOT NULL AND object_value IS NOT NULL) SELECT subject_entity_id, predicate, datatype, count(DISTINCT claim_id) AS claims, count(DISTINCT object_value) AS answers, CASE WHEN count(DISTINCT object_value) > 1 THEN 'DISPUTED' ELSE 'SUPPORTED' END AS expected FROM c GROUP BY ALL UNION ALL SELECT 'entity_unknown', 'display_name', 'none', 0, 0, 'UNKNOWN'",
    "version_candidates": _R + "SELECT case_id, source_native_id, count(*) AS versions, string_agg(DISTINCT source_object_id, ',' ORDER BY source_object_id) AS sources FROM b JOIN documents USING (doc_id) WHERE source_native_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
}
