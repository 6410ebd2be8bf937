"""Checks over the tables: requests, labels, replies, frozen runs, and what texts show by their structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import anchors, latest_date
from tessella.operators import checks as K
from tessella.operators.intake import once
from tessella.plans import table
from tessella.plans.scores import _best, _runs

_SCOPES = ["conflicting_info", "lookup", "multi_hop"]
_SECTIONS = ("Summary", "Goals", "Owner", "Impact", "Notes", "Status")


def request_faults(spark, d):
    """Listed questions as dossier requests: what is wrong with each."""
    q = table(spark, d, "conflict_case").select("question_id", "question", "question_type").distinct()
    return q.select("question_id", "question", K.request_fault(F.col("question"), F.col("question_id"), F.lower(F.regexp_extract("question", r"([A-Za-z]+) limit", 1)), F.col("question_type"), _SCOPES).alias("fault"))


def manifest_faults(spark, d):
    """The manifest's rows that can't be run, and the sources of the others in order."""
    q = table(spark, d, "conflict_case").distinct()
    fault = K.manifest_fault(F.array(F.lit("question_id"), F.lit("question")), ["question_id", "question", "source_types", "maximum_documents", "prompt_version"], F.col("question"), F.col("source_types"), F.col("maximum_documents"), 10)
    return q.select("question_id", "maximum_documents", F.array_join(K.sorted_sources(F.col("source_types")), ",").alias("sources"), fault.alias("fault"))


def label_faults(spark, d):
    """Runs read as labels: repeated ids, unknown verdicts, missing evidence."""
    r = table(spark, d, "causal_score_row").where("status = 'completed'").select("row_id", "verdict", F.coalesce("evidence_document_ids", F.array().cast("array<bigint>")).alias("evidence"))
    return K.label_faults(r, "row_id", "verdict", "evidence").groupBy("fault").agg(F.count(F.lit(1)).alias("labels"))


def holdout_faults(spark, d):
    """Listed cases without exactly one run of the full arm, and runs of cases that aren't listed."""
    listed = table(spark, d, "conflict_case").where("question_id IS NOT NULL").select(F.col("question_id").alias("case_id"))
    every = once(table(spark, d, "causal_score_row"), ["row_id"], [F.col("loaded_at").asc(), F.col("latency_ms").asc()])
    runs = every.where("case_id IS NOT NULL AND replace(lower(trim(arm_id)), '-', '_') RLIKE '^full_[a-z]+_grounding$'")
    return K.accounting_faults(listed, runs, "case_id")


def event_digests(spark, d):
    """Digests of events' JSON by content, whatever its spacing: how many there are of each type."""
    e = table(spark, d, "events").select("event_type", K.json_digest(F.col("props")).alias("digest"), K.json_at(F.col("props"), "/k").alias("k"), K.forbidden_path(F.col("props"), ("k",)).alias("path"))
    return e.groupBy("event_type").agg(F.count_distinct("digest").alias("digests"), F.count_distinct("k").alias("values"), F.count_if(F.col("path") == "$.k").alias("with_key"))


def forbidden_keys(spark, d):
    """Listed questions as JSON, half of them with a label inside: where it stands."""
    q = table(spark, d, "conflict_case").select("question_id", "maximum_documents").distinct()
    labelled = F.when(F.col("maximum_documents") % 2 == 0, F.lit('{"case":[{"gold_answer":1}]}')).otherwise(F.lit('{"case":[{"answer":"gold"}]}'))
    return q.select("question_id", "maximum_documents", K.forbidden_path(labelled).alias("path"))


def observation_faults(spark, d):
    """Claims read as observations quoted from their document's title: what isn't grounded, by predicate."""
    c = table(spark, d, "claim").select("claim_id", "predicate", "object_value", "source_object_id").distinct()
    docs = table(spark, d, "documents").select("source_object_id", "title")
    fault = K.observation_fault(F.col("predicate"), F.col("object_value"), F.col("title"), F.col("title"))
    return c.join(docs, "source_object_id").select("claim_id", fault.alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("claims"))


def response_grounding(spark, d):
    """Documents' claims as responses, accepted as a whole or not at all: a claim needs a slug and a value."""
    c = table(spark, d, "claim").select("claim_id", "predicate", "object_value", "source_object_id").where("source_object_id IS NOT NULL").distinct()
    fault = K.first_fault({"predicate": F.col("predicate").rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), "malformed": F.length(F.trim("object_value")) > 0})
    return K.grounded_responses(c.withColumn("fault", fault), "source_object_id", "fault").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("responses"), F.sum("observations").alias("observations"))


def numeric_facts(spark, d):
    """What claims' values state as numbers, and the naive alignment of their predicates."""
    c = table(spark, d, "claim").where("object_value IS NOT NULL").select("claim_id", "predicate", "object_value").distinct()
    f = K.numeric_fact(F.col("object_value"))
    return c.select("claim_id", f["kind"].alias("kind"), f["value"].alias("value"), f["unit"].alias("unit"), K.naive_target(F.col("predicate")).alias("naive"))


def question_hints(spark, d):
    """Subjects, people and alignment words that questions name."""
    q = table(spark, d, "conflict_case").select("question_id", "question").distinct()
    return q.select("question_id", K.subject_hint(F.col("question"), F.col("question_id")).alias("subject"), F.array_join(K.person_names(F.col("question")), "|").alias("people"), K.names_alignment(F.col("question")).alias("aligns"), K.evidence_id(F.col("question_id"), F.concat(F.lit("jira · "), "question_id")).alias("evidence"))


def _cited(spark, d):
    """Questions with their documents, the question's anchors and the score of each document's wording."""
    q = table(spark, d, "conflict_case").where("question_id IS NOT NULL").groupBy(F.col("question_id").alias("case_id")).agg(F.min("question").alias("question"))
    docs = table(spark, d, "documents").select("doc_id", "title", "source_type", F.coalesce("text", F.lit("")).alias("text"))
    found = _best(spark, d).join(q, "case_id").join(docs, "doc_id")
    stage = F.when(F.col("text").rlike("(?i)approved"), "approved").when(F.col("text").rlike("(?i)proposal"), "proposal").otherwise("unknown")
    return found.select("case_id", "doc_id", "place", "source_type", K.precedence_score(F.col("text"), F.col("title"), stage, anchors(F.col("question"))).alias("score"), latest_date(F.col("text")).alias("dated"), F.coalesce(F.col("question").rlike("(?i)latest|current"), F.lit(False)).alias("asks_latest"))


def precedence_scores(spark, d):
    return _cited(spark, d).select("case_id", "doc_id", "score")


def conflict_promotions(spark, d):
    """Conflicts out of the first two documents of each question, of one kind of source, by their precedence."""
    x = _cited(spark, d).select("case_id", F.col("doc_id").alias("id"), F.when(F.col("place") <= 4, "accepted").otherwise("rejected").alias("status"), (F.col("doc_id") % 3).cast("string").alias("subject"), (F.col("doc_id") % 5).cast("string").alias("value"), "score", "dated", "asks_latest", "place")
    return K.promotions(x, "case_id", ["place"])


def schema_observations(spark, d):
    """How many records of each system show each surface: addresses of mails, authors and code of chats, sections of pages."""
    probes = [(s, n, K.PROBES[n]) for s, names in (("slack", ("author", "message", "code_block")), ("fireflies", ("author", "message")), ("gmail", ("from", "to", "subject", "date"))) for n in names]
    probes += [(s, label, rf"(?i)(?:^|\n| \| |^#+\s*){label}(?:[ \t]*:|[ \t]*\||\r?\n|$)") for s in ("confluence", "jira", "google_drive", "hubspot", "linear", "github") for label in _SECTIONS]
    rules = F.broadcast(spark.createDataFrame(probes, "system string, surface string, pattern string"))
    seen = K.schema_observations(table(spark, d, "documents"), "doc_id", "source_type", "text", rules)
    return seen.groupBy("source_type", "surface").agg(F.count(F.lit(1)).alias("records"), F.count_if("present").alias("present"))


def frozen_faults(spark, d):
    """Runs read as frozen results: completed ones need a verdict and evidence, others none; the digest of every third is altered."""
    r = _runs(spark, d).select("case_id", "arm", "status", "verdict", F.array_join("evidence_document_ids", ",").alias("evidence"), F.when(F.col("status") != "completed", F.col("status")).alias("reason"), "row_id")
    own = F.sha2(F.concat_ws("|", "case_id", "arm", F.coalesce("status", F.lit("")), F.coalesce("verdict", F.lit("")), F.coalesce("evidence", F.lit(""))), 256)
    frozen = r.withColumn("digest", F.when(F.col("row_id") % 3 == 0, F.lit("0")).otherwise(own))
    return K.frozen_faults(frozen, "row_id", "status", "verdict", "evidence", "reason", "digest", own).groupBy("fault").agg(F.count(F.lit(1)).alias("runs"))


QUERIES = {f.__name__: f for f in (request_faults, manifest_faults, label_faults, holdout_faults, event_digests, forbidden_keys, observation_faults, response_grounding, numeric_facts, question_hints, precedence_scores, conflict_promotions, schema_observations, frozen_faults)}

from tessella.plans.scores import _R  # noqa: E402

_Q = "WITH q AS (SELECT DISTINCT question_id, question, question_type FROM conflict_case) "
_POINTS = lambda x, rules: " + ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN {w} ELSE 0 END" for p, w in rules)
SQL = {
    "request_faults": _Q + "SELECT question_id, question, CASE WHEN NOT coalesce(length(trim(question, ' ')) BETWEEN 8 AND 240, false) THEN 'question' WHEN NOT coalesce(regexp_matches(question_id, '^[\\p{L}\\p{N}][\\p{L}\\p{N} ._:@-]{0,119}$'), false) THEN 'entity' WHEN NOT coalesce(regexp_matches(lower(regexp_extract(question, '([A-Za-z]+) limit', 1)), '^[a-z][a-z0-9_]{0,63}$'), false) THEN 'predicate' WHEN NOT coalesce(question_type IN ('conflicting_info', 'lookup', 'multi_hop'), false) THEN 'scope' END AS fault FROM q",
    "manifest_faults": "SELECT DISTINCT question_id, maximum_documents, array_to_string(list_sort(list_distinct(source_types)), ',') AS sources, CASE WHEN NOT coalesce(length(trim(question, ' ')) > 0, false) THEN 'question' WHEN NOT coalesce(len(list_distinct(source_types)) > 0, false) THEN 'sources' WHEN NOT coalesce(maximum_documents BETWEEN 1 AND 10, false) THEN 'documents' END AS fault FROM (SELECT DISTINCT * FROM conflict_case)",
    "label_faults": "WITH r AS (SELECT row_id, verdict, len(coalesce(evidence_document_ids, [])) AS n, count(*) OVER (PARTITION BY row_id) AS k FROM causal_score_row WHERE status = 'completed') SELECT CASE WHEN row_id IS NULL THEN 'no_key' WHEN k > 1 THEN 'repeated' WHEN NOT coalesce(verdict IN ('SUPPORTED', 'DISPUTED', 'NOT_FOUND', 'UNKNOWN'), false) THEN 'verdict' WHEN verdict IN ('SUPPORTED', 'DISPUTED') AND n = 0 THEN 'evidence' END AS fault, count(*) AS labels FROM r GROUP BY 1",
    "holdout_faults": "WITH l AS (SELECT DISTINCT question_id AS case_id, true AS listed FROM conflict_case WHERE question_id IS NOT NULL), r AS (SELECT case_id, count(DISTINCT row_id) AS n FROM causal_score_row WHERE case_id IS NOT NULL AND regexp_matches(replace(lower(trim(arm_id, ' ')), '-', '_'), '^full_[a-z]+_grounding$') GROUP BY 1) SELECT case_id, CASE WHEN listed IS NULL THEN 'unlisted' WHEN n IS NULL THEN 'not_run' ELSE 'run_again' END AS fault FROM l FULL JOIN r USING (case_id) WHERE listed IS NULL OR n IS NULL OR n > 1",
    "event_digests": "WITH e AS (SELECT event_type, CASE WHEN json_valid(props) THEN props END AS p FROM events) SELECT event_type, count(DISTINCT CAST(json(p) AS VARCHAR)) AS digests, count(DISTINCT CAST(json_extract(p, '$.k') AS VARCHAR)) AS values, count(*) FILTER (WHERE json_exists(p, '$.k')) AS with_key FROM e GROUP BY 1",
    "forbidden_keys": "SELECT DISTINCT question_id, maximum_documents, CASE WHEN maximum_documents % 2 = 0 THEN '$.case[0].gold_answer' END AS path FROM conflict_case",
    "response_grounding": "WITH c AS (SELECT DISTINCT claim_id, predicate, object_value, source_object_id FROM claim WHERE source_object_id IS NOT NULL), f AS (SELECT source_object_id, CASE WHEN NOT coalesce(regexp_matches(predicate, '^[a-z0-9]+(_[a-z0-9]+)*$'), false) THEN 'invalid_schema' WHEN NOT coalesce(length(trim(object_value, ' ')) > 0, false) THEN 'malformed_output' END AS f FROM c), r AS (SELECT source_object_id, min(f) AS reason, count(*) AS n FROM f GROUP BY 1) SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS responses, sum(n)::BIGINT AS observations FROM r GROUP BY ALL",
    "numeric_facts": "WITH c AS (SELECT DISTINCT claim_id, predicate, object_value AS v FROM claim WHERE object_value IS NOT NULL), p AS (SELECT *, regexp_extract(trim(v, ' '), '^(-?[0-9]+(?:\\.[0-9]+)?)%$', 1) AS s, regexp_extract(v, '(?i)(-?[0-9]+(?:\\.[0-9]+)?)\\s*(milliseconds?|ms|seconds?|secs?|s|minutes?|mins?|hours?|hrs?)\\b', 1) AS n, lower(regexp_extract(v, '(?i)(-?[0-9]+(?:\\.[0-9]+)?)\\s*(milliseconds?|ms|seconds?|secs?|s|minutes?|mins?|hours?|hrs?)\\b', 2)) AS u, regexp_replace(regexp_replace(lower(regexp_replace(trim(predicate, ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS g FROM c) SELECT claim_id, CASE WHEN s <> '' THEN 'percentage' WHEN n <> '' THEN 'duration' END AS kind, CASE WHEN s <> '' THEN s::DOUBLE WHEN n <> '' THEN n::DOUBLE END AS value, CASE WHEN s <> '' OR n = '' THEN NULL WHEN regexp_matches(u, '^(ms|millisecond)') THEN 'milliseconds' WHEN u LIKE 's%' THEN 'seconds' WHEN u LIKE 'min%' THEN 'minutes' ELSE 'hours' END AS unit, CASE g WHEN 'owner' THEN 'OWNS' WHEN 'assignee' THEN 'ASSIGNED_TO' WHEN 'reviewer' THEN 'REVIEWS' ELSE upper(g) END AS naive FROM p",
    "question_hints": _Q + "SELECT question_id, CASE WHEN regexp_extract(question, '(?i)\\b[a-z]+-[0-9]+(?:-[a-z0-9]+)+\\b') <> '' THEN regexp_extract(question, '(?i)\\b[a-z]+-[0-9]+(?:-[a-z0-9]+)+\\b') ELSE question_id END AS subject, array_to_string(regexp_extract_all(question, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,2}\\b'), '|') AS people, regexp_matches(question, '(?i)owner|assignee|reporter|reviewer|responsible') AS aligns, question_id AS evidence FROM q",
    "schema_observations": "WITH p(system, surface, pattern) AS (VALUES " + ", ".join("('" + "', '".join(x) + "')" for x in ([(s, n, K.PROBES[n].replace("'", "''")) for s, names in (("slack", ("author", "message", "code_block")), ("fireflies", ("author", "message")), ("gmail", ("from", "to", "subject", "date"))) for n in names] + [(s, label, rf"(?i)(?:^|\n| \| |^#+\s*){label}(?:[ \t]*:|[ \t]*\||\r?\n|$)") for s in ("confluence", "jira", "google_drive", "hubspot", "linear", "github") for label in _SECTIONS])) + ") SELECT source_type, surface, count(*) AS records, count(*) FILTER (WHERE regexp_matches(replace(coalesce(text, ''), '\\n', chr(10)), pattern)) AS present FROM documents JOIN p ON system = source_type GROUP BY ALL",
    "frozen_faults": _R + "SELECT CASE WHEN NOT coalesce(status IN ('completed', 'rejected', 'failed'), false) THEN 'status' WHEN (status = 'completed') <> coalesce(length(trim(verdict, ' ')) > 0, false) THEN 'answer' WHEN status = 'completed' AND len(own) = 0 THEN 'evidence' WHEN row_id % 3 = 0 THEN 'digest' END AS fault, count(*) AS runs FROM r GROUP BY 1",
}
