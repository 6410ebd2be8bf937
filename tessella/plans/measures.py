"""Measures over decisions, attempts, arms and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import ratio
from tessella.operators import quality as Q
from tessella.operators.intake import once
from tessella.plans import table


def _arm(x="arm_id"):
    return F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit("_"))


def _runs(spark, d):
    first = [F.col("loaded_at").asc_nulls_last(), F.col("latency_ms").asc_nulls_last()]
    return once(table(spark, d, "causal_score_row"), ["row_id"], first).withColumn("arm", _arm())


def _fine():
    return F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")


def identity_quality(spark, d):
    """Acceptance of a pair by its row against the majority of its rows, by algorithm."""
    x = table(spark, d, "identity_decision").where(F.size("candidate_source_object_ids") == 2).distinct()
    s = F.regexp_replace(F.lower("status"), r"\s", "")
    pairs = x.select("algorithm_version", (s == "accepted").alias("guess"), (F.col("score") >= 0.5).alias("truth"))
    return _rounded(Q.pair_quality(pairs, "truth", "guess", ["algorithm_version"]))


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def signal_strata(spark, d):
    """The same by each signal of the pair."""
    s = F.regexp_replace(F.lower("status"), r"\s", "")
    x = table(spark, d, "identity_decision").distinct().select(F.explode("signals").alias("signal"), (s == "accepted").alias("guess"), (F.col("score") >= 0.5).alias("truth"))
    return _rounded(Q.pair_quality(x, "truth", "guess", ["signal"]))


def _cells(spark, d):
    e = table(spark, d, "documents").select("doc_id", F.col("source_native_id").alias("cluster"), F.col("source_type").alias("truth"))
    return Q.cell_counts(e, "doc_id", "cluster", "truth")


def b_cubed(spark, d):
    return _rounded(Q.b_cubed(_cells(spark, d), "cluster", "truth"))


def cluster_purity(spark, d):
    return _rounded(Q.purity(_cells(spark, d), "cluster"))


def verdict_confusion(spark, d):
    """Verdicts of grounded runs against those of plain ones of the same case."""
    r = _runs(spark, d).where("verdict IS NOT NULL")
    one = lambda arm, name: r.where(F.col("arm") == arm).groupBy("case_id").agg(F.min_by("verdict", "row_id").alias(name))
    return Q.confusion(one("current_evidence_pinning", "expected").join(one("plain_retrieval", "actual"), "case_id"), "expected", "actual", ["SUPPORTED", "DISPUTED", "NOT_FOUND", "UNKNOWN"])


def _evidence(spark, d):
    """Runs with the evidence of the case's candidates."""
    best = table(spark, d, "retrieval_candidate").where("score >= 0.4 AND NOT isnan(score)").select(F.col("question_id").alias("case_id"), "doc_id")
    return Q.listed_overlap(_runs(spark, d), ["row_id", "arm"], "case_id", "evidence_document_ids", best, "doc_id")


def case_metrics(spark, d):
    e = _evidence(spark, d)
    hits, misses, extras = (F.sum(c) for c in ("hits", "misses", "extras"))
    return _rounded(e.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), ratio(hits, hits + misses).alias("recall"), ratio(hits, hits + extras).alias("precision"), F.count_if(F.col("extras") > 0).alias("with_extras")))


def attempt_metrics(spark, d):
    """Listed questions left-joined to their runs: those without any count as not run."""
    q = table(spark, d, "conflict_case").select(F.col("question_id").alias("case_id"), "question_type").distinct()
    r = _runs(spark, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("verdict").isin("UNKNOWN", "DISPUTED")).alias("abstained"))
    j = q.join(r, "case_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return _rounded(j.groupBy("question_type").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("attempts").isNull()).alias("not_run"), n("attempts").alias("attempts"), ratio(n("completed"), n("attempts")).alias("completed"), ratio(n("abstained"), n("completed")).alias("abstained")))


def unlisted_runs(spark, d):
    """Runs of cases that aren't listed, and listed ones never run."""
    q = table(spark, d, "conflict_case").select(F.col("question_id").alias("case_id")).distinct()
    r = _runs(spark, d)
    lost = r.join(q, "case_id", "left_anti").agg(F.lit("unlisted").alias("what"), F.count(F.lit(1)).alias("n"))
    return lost.unionByName(q.join(r, "case_id", "left_anti").agg(F.lit("never_run").alias("what"), F.count(F.lit(1)).alias("n")))


def trial_summary(spark, d):
    x = _runs(spark, d).where(_fine())
    p = lambda q: Q.nearest_rank("latency_ms", q).alias(f"p{q}")
    return _rounded(x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("latency_ms").alias("least"), F.median("latency_ms").alias("median"), p(95), p(99), F.max("latency_ms").alias("most")))


def latency_grid(spark, d):
    """Latencies by budget and number of documents: two dimensions and their totals."""
    x = _runs(spark, d).where(_fine() & F.col("context_token_budget").isNotNull())
    g = x.rollup("context_token_budget", "context_document_count").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.grouping_id().alias("level"))
    return g.withColumn("level", F.col("level").cast("int"))


def causal_arm_score(spark, d):
    r = _runs(spark, d)
    done = F.col("status") == "completed"
    return _rounded(r.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), ratio(F.count_if(done), F.count(F.lit(1))).alias("completed"), ratio(F.count_if(done & (F.col("verdict") == "SUPPORTED")), F.count_if(done)).alias("supported"), F.count_if(F.col("verdict") == "UNKNOWN").alias("abstained"), F.sum("context_document_count").alias("documents"), F.sum("model_input_tokens").alias("tokens")))


def token_parity(spark, d):
    """Of each case: whether all its runs had one token budget; unverifiable if any lacks it."""
    c = _runs(spark, d).groupBy("case_id").agg(F.count_distinct("context_token_budget").alias("budgets"), F.count_if(F.col("context_token_budget").isNull()).alias("unknown"))
    kind = F.when(F.col("unknown") > 0, "unverifiable").when(F.col("budgets") == 1, "matched").otherwise("mismatched")
    return c.groupBy(kind.alias("parity")).agg(F.count(F.lit(1)).alias("cases"))


def loss_diagnosis(spark, d):
    """Cases in which taking an arm away changes the verdict of the plain one."""
    r = _runs(spark, d).where("status = 'completed' AND verdict IS NOT NULL AND arm IS NOT NULL")
    by = r.groupBy("case_id", "arm").agg(F.min_by("verdict", "row_id").alias("v"))
    plain = by.where("arm = 'plain_retrieval'").select("case_id", F.col("v").alias("plain"))
    return by.where("arm <> 'plain_retrieval'").join(plain, "case_id").groupBy("arm").agg(F.count_if(F.col("v") != F.col("plain")).alias("changed"), F.count(F.lit(1)).alias("cases"))


def safety_score(spark, d):
    """Evidence before and after documents of several versions are taken out."""
    several = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("source_object_id")).distinct().join(table(spark, d, "documents").select("source_object_id", "doc_id"), "source_object_id").select("doc_id")
    c = table(spark, d, "retrieval_candidate").select("question_id", "doc_id").distinct()
    marked = c.join(several.withColumn("several", F.lit(True)), "doc_id", "left")
    per = marked.groupBy("question_id").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("several").isNull()).alias("after"))
    return per.groupBy((F.col("after") < F.col("before")).alias("touched")).agg(F.count(F.lit(1)).alias("questions"), F.sum("before").alias("before"), F.sum("after").alias("after"))


def judgment_reuse(spark, d):
    """Runs whose (case, verdict, evidence) has been judged in an earlier run."""
    from pyspark.sql import Window

    key = ["case_id", "verdict", "evidence"]
    r = _runs(spark, d).where("verdict IS NOT NULL").withColumn("evidence", F.array_join(F.array_sort(F.array_distinct("evidence_document_ids")), ","))
    k = F.row_number().over(Window.partitionBy(*key).orderBy("row_id"))
    return r.withColumn("k", k).groupBy("arm").agg(F.count_if(F.col("k") == 1).alias("judged"), F.count_if(F.col("k") > 1).alias("reused"))


def replay_difference(spark, d):
    """The rows in which an intake differs from a replay that lacks documents never observed and has those of groups of versions twice."""
    c = table(spark, d, "documents").select("doc_id", "payload_digest", "source_type", "source_object_id", "observed_at")
    several = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("source_object_id")).distinct()
    again = c.where("observed_at IS NOT NULL")
    return Q.same_rows(c.select("doc_id", "payload_digest", "source_type"), again.unionByName(again.join(several, "source_object_id", "left_semi")).select("doc_id", "payload_digest", "source_type"))


QUERIES = {f.__name__: f for f in (identity_quality, signal_strata, b_cubed, cluster_purity, verdict_confusion, case_metrics, attempt_metrics, unlisted_runs, trial_summary, latency_grid, causal_arm_score, token_parity, loss_diagnosis, safety_score, judgment_reuse, replay_difference)}

_R = "WITH r AS (SELECT *, replace(lower(trim(arm_id, ' ')), '-', '_') AS arm FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at) AS k FROM causal_score_row) WHERE k = 1) "
_X = "WITH x AS (SELECT DISTINCT * FROM identity_decision), y AS (SELECT {c} AS {n}, regexp_replace(lower(status), '\\s', '', 'g') = 'accepted' AS g, CASE WHEN isnan(score) THEN true ELSE score >= 0.5 END AS t FROM x {w}), c AS (SELECT {n}, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM y WHERE t IS NOT NULL AND g IS NOT NULL GROUP BY 1), p AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM c) SELECT {n}, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM p"
_CELLS = "WITH z AS (SELECT source_native_id AS cluster, source_type AS truth, count(DISTINCT doc_id) AS n FROM documents WHERE source_native_id IS NOT NULL AND source_type IS NOT NULL GROUP BY ALL) "
_EV = _R + ", b AS (SELECT question_id AS case_id, list(DISTINCT doc_id) AS expected FROM retrieval_candidate WHERE score >= 0.4 AND NOT isnan(score) GROUP BY 1), e AS (SELECT arm, len(list_intersect(expected, a)) AS hits, len(expected) - len(list_intersect(expected, a)) AS misses, len(a) - len(list_intersect(expected, a)) AS extras FROM (SELECT arm, expected, list_distinct(coalesce(evidence_document_ids, [])) AS a FROM r JOIN b USING (case_id))) "
SQL = {
    "identity_quality": _X.format(c="algorithm_version", n="algorithm_version", w="WHERE len(candidate_source_object_ids) = 2"),
    "signal_strata": _X.format(c="unnest(signals)", n="signal", w=""),
    "b_cubed": _CELLS + ", w AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY truth) AS t FROM z), a AS (SELECT sum(n)::BIGINT AS items, sum(n * n / c::DOUBLE) / sum(n) AS p, sum(n * n / t::DOUBLE) / sum(n) AS r FROM w) SELECT items, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM a",
    "cluster_purity": _CELLS + ", c AS (SELECT cluster, max(n) AS m, sum(n) AS s FROM z GROUP BY 1) SELECT count(*) AS clusters, sum(s)::BIGINT AS items, round(sum(m) / sum(s)::DOUBLE, 9) AS purity FROM c",
    "verdict_confusion": _R + ", e AS (SELECT case_id, arg_min(verdict, row_id) AS expected FROM r WHERE verdict IS NOT NULL AND arm = 'current_evidence_pinning' GROUP BY 1), a AS (SELECT case_id, arg_min(verdict, row_id) AS actual FROM r WHERE verdict IS NOT NULL AND arm = 'plain_retrieval' GROUP BY 1), j AS (SELECT * FROM e JOIN a USING (case_id)) SELECT v AS expected, " + ", ".join(f"count(*) FILTER (WHERE actual = '{v}') AS \"{v}\"" for v in ("SUPPORTED", "DISPUTED", "NOT_FOUND", "UNKNOWN")) + " FROM (SELECT unnest(['SUPPORTED', 'DISPUTED', 'NOT_FOUND', 'UNKNOWN']) AS v) LEFT JOIN j ON expected = v GROUP BY v",
    "case_metrics": _EV + "SELECT arm, count(*) AS runs, round(sum(hits) / nullif(sum(hits + misses), 0)::DOUBLE, 9) AS recall, round(sum(hits) / nullif(sum(hits + extras), 0)::DOUBLE, 9) AS precision, count(*) FILTER (WHERE extras > 0) AS with_extras FROM e GROUP BY arm",
    "attempt_metrics": _R + ", q AS (SELECT DISTINCT question_id AS case_id, question_type FROM conflict_case), n AS (SELECT case_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE verdict IN ('UNKNOWN', 'DISPUTED')) AS abstained FROM r GROUP BY 1) SELECT question_type, count(*) AS questions, count(*) FILTER (WHERE attempts IS NULL) AS not_run, coalesce(sum(attempts), 0)::BIGINT AS attempts, round(sum(completed) / nullif(sum(attempts), 0)::DOUBLE, 9) AS completed, round(sum(abstained) / nullif(sum(completed), 0)::DOUBLE, 9) AS abstained FROM q LEFT JOIN n USING (case_id) GROUP BY 1",
    "unlisted_runs": _R + "SELECT 'unlisted' AS what, count(*) AS n FROM r WHERE case_id IS NULL OR case_id NOT IN (SELECT question_id FROM conflict_case WHERE question_id IS NOT NULL) UNION ALL SELECT 'never_run', count(DISTINCT question_id) FROM conflict_case WHERE question_id NOT IN (SELECT case_id FROM r WHERE case_id IS NOT NULL)",
    "trial_summary": _R + "SELECT status, count(*) AS n, min(latency_ms) AS least, round(median(latency_ms), 9) AS median, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS most FROM r WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY 1",
    "latency_grid": _R + "SELECT context_token_budget, context_document_count, count(*) AS n, round(avg(latency_ms), 4) AS mean, grouping_id(context_token_budget, context_document_count)::INT AS level FROM r WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND context_token_budget IS NOT NULL GROUP BY ROLLUP (context_token_budget, context_document_count)",
    "causal_arm_score": _R + "SELECT arm, count(*) AS runs, round(count(*) FILTER (WHERE status = 'completed') / count(*)::DOUBLE, 9) AS completed, round(count(*) FILTER (WHERE status = 'completed' AND verdict = 'SUPPORTED') / nullif(count(*) FILTER (WHERE status = 'completed'), 0)::DOUBLE, 9) AS supported, count(*) FILTER (WHERE verdict = 'UNKNOWN') AS abstained, sum(context_document_count)::BIGINT AS documents, sum(model_input_tokens)::BIGINT AS tokens FROM r GROUP BY 1",
    "token_parity": _R + ", c AS (SELECT case_id, count(DISTINCT context_token_budget) AS b, count(*) FILTER (WHERE context_token_budget IS NULL) AS u FROM r GROUP BY 1) SELECT CASE WHEN u > 0 THEN 'unverifiable' WHEN b = 1 THEN 'matched' ELSE 'mismatched' END AS parity, count(*) AS cases FROM c GROUP BY 1",
    "loss_diagnosis": _R + ", b AS (SELECT case_id, arm, arg_min(verdict, row_id) AS v FROM r WHERE status = 'completed' AND verdict IS NOT NULL AND arm IS NOT NULL GROUP BY ALL) SELECT b.arm, count(*) FILTER (WHERE b.v <> p.v) AS changed, count(*) AS cases FROM b JOIN b p ON p.case_id = b.case_id AND p.arm = 'plain_retrieval' WHERE b.arm <> 'plain_retrieval' GROUP BY 1",
    "safety_score": "WITH s AS (SELECT DISTINCT doc_id FROM (SELECT unnest(source_object_ids) AS source_object_id FROM source_version_group) JOIN documents USING (source_object_id)), c AS (SELECT DISTINCT question_id, doc_id FROM retrieval_candidate), p AS (SELECT question_id, count(*) AS b, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS a FROM c GROUP BY 1) SELECT a < b AS touched, count(*) AS questions, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM p GROUP BY 1",
    "judgment_reuse": _R + ", e AS (SELECT *, array_to_string(list_sort(list_distinct(evidence_document_ids)), ',') AS evidence FROM r WHERE verdict IS NOT NULL), j AS (SELECT *, row_number() OVER (PARTITION BY case_id, verdict, evidence ORDER BY row_id) AS k2 FROM e) SELECT arm, count(*) FILTER (WHERE k2 = 1) AS judged, count(*) FILTER (WHERE k2 > 1) AS reused FROM j GROUP BY 1",
    "replay_difference": "SELECT count(*) FILTER (WHERE observed_at IS NULL) AS only_a, count(*) FILTER (WHERE observed_at IS NOT NULL AND source_object_id IN (SELECT unnest(source_object_ids) FROM source_version_group)) AS only_b FROM documents",
}
