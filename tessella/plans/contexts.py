"""Alignment, coverage, contexts of arms, wording and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import alignment as A
from tessella.operators import contexts as X
from tessella.operators.intake import once
from tessella.plans import table
from tessella.staging import stage

_TERMS = (("owner_team", "OWNED_BY", "service", "team"), ("approver", "APPROVED_BY", "service", "person"), ("region", "LOCATED_IN", "service", "place"), ("burst_limit", "HAS_LIMIT", "service", "number"), ("retention_days", "HAS_LIMIT", "service", "number"), ("service_tier", "HAS_TIER", "service", "tier"))
_RULES = (("owner_team", "OWNED_BY", "service", "team"), ("approver", "APPROVED_BY", "service", "team"), ("region", "LOCATED_IN", "team", "place"), ("burst_limit", "HAS_LIMIT", "service", "number"), ("service_tier", "TIER", "service", "tier"))

#: Lines of a document, in their order, that a question looks at first.
_HEAD = 16


def _small(spark, rows, columns):
    return F.broadcast(spark.createDataFrame(list(rows), columns))


def _terms(spark, d):
    observed = table(spark, d, "claim").where("predicate IS NOT NULL").select(F.lower(F.trim("source_system")).alias("system"), F.col("datatype").alias("object_type"), F.col("predicate").alias("field"))
    hints = [(None, None, f, t) for f, t, _, _ in _TERMS] + [("jira", "string", "owner_team", "ASSIGNED_TO")]
    return A.source_terms(observed, _small(spark, hints, "system string, object_type string, field string, target string"))


def alignment_terms(spark, d):
    return _terms(spark, d)


def alignment_decisions(spark, d):
    onto = {t: (dom, ran) for _, t, dom, ran in _TERMS}
    return A.alignment_decisions(_terms(spark, d), _small(spark, [(t, *x) for t, x in onto.items()], "target string, domain string, range string"), _small(spark, _RULES, "surface string, target string, domain string, range string"))


def coverage_gaps(spark, d):
    """Which systems' claims cover the policies' predicates, by extraction method.

    A slice is partial where more than 7 % of its claims have no value, and failed beyond 20 %.
    """
    lost = F.count_if(F.col("object_value").isNull()) / F.count(F.lit(1))
    c = table(spark, d, "claim")
    slices = c.groupBy(F.lower(F.trim("source_system")).alias("system"), F.col("extraction_method").alias("object_type")).agg(F.when(lost > 0.2, "failed").when(lost > 0.07, "partial").otherwise("complete").alias("status"), F.array_sort(F.collect_set("predicate")).alias("predicates"))
    p = table(spark, d, "authority_policy").select(F.lower(F.trim("source_system")).alias("system"), "predicate").distinct()
    required = p.crossJoin(_small(spark, [("llm",), ("structural",), ("manual",)], "object_type string")).select("system", "object_type", "predicate")
    return A.coverage_gaps(required, slices)


def matched_removal(spark, d):
    """Of each question's context documents of several versions, and what of equal length stands in for them."""
    docs = table(spark, d, "documents").select("doc_id", "source_object_id", X.token_count(F.col("text")).alias("tokens"))
    several = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("source_object_id")).distinct().withColumn("several", F.lit(True))
    marked = docs.join(several, "source_object_id", "left").select("doc_id", "tokens", F.coalesce("several", F.lit(False)).alias("removed"))
    c = table(spark, d, "retrieval_candidate").where("score IS NOT NULL AND NOT isnan(score)").groupBy("question_id", "doc_id").agg(F.max("score").alias("score")).join(marked, "doc_id")
    band = c.withColumn("tokens", F.floor(F.col("tokens") / 50))
    return X.replace_removed(band.where("score >= 0.3"), "question_id", "doc_id", "removed", "tokens", band.where("NOT removed").select("question_id", "doc_id", "tokens"))


def diverse_segments(spark, d):
    """Three different lines of each listed question's best documents, all those that ``title_hits`` ranks.

    Lines are chosen by falling score and then in their own order, so three that the first lines of the documents of the best score
    give are final where all lines left out come after them; only questions that these leave open are worked through with all
    lines of all their documents.
    """
    from tessella.plans.search import title_hits

    most, budget = 3, 900
    hits = stage(title_hits(spark, d).select("question_id", "doc_id", "score"), "hits")
    line = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & (F.length(x) <= budget))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_sort(F.array_distinct(line)).alias("lines"))

    def chosen(found):
        return X.diverse_spans(found.select("question_id", "score", F.explode("lines").alias("segment")), "question_id", "segment", "score", most, budget)

    best = hits.groupBy("question_id").agg(F.max("score").alias("score"))
    heads = docs.select("doc_id", F.slice("lines", 1, _HEAD).alias("lines"), F.when(F.size("lines") > _HEAD, F.col("lines")[_HEAD - 1]).alias("cut"))
    short = stage(hits.join(best, ["question_id", "score"], "left_semi").join(heads, "doc_id"), "heads")
    cuts = short.groupBy("question_id").agg(F.min("cut").alias("cut"))
    first = stage(chosen(short).join(cuts, "question_id"), "first")
    full = first.where((F.col("place") == most) & (F.col("cut").isNull() | (F.col("segment") <= F.col("cut")))).select("question_id")
    rest = chosen(hits.join(full, "question_id", "left_anti").join(docs, "doc_id"))
    return first.join(full, "question_id", "left_semi").drop("cut").unionByName(rest)


def wording_precedence(spark, d):
    return table(spark, d, "documents").select("source_type", X.precedence(F.coalesce("text", F.lit(""))).alias("precedence")).groupBy("source_type", "precedence").agg(F.count(F.lit(1)).alias("documents"))


def word_prefixes(spark, d):
    """The first twenty words of each version of a group, with their own white space."""
    members = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("source_object_id")).distinct()
    return table(spark, d, "documents").join(members, "source_object_id", "left_semi").select("doc_id", X.word_prefix(F.col("text"), 20).alias("head"))


def audited_lines(spark, d):
    return X.scan(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


def answer_faults(spark, d):
    """Runs whose evidence isn't among their case's candidates."""
    given = table(spark, d, "retrieval_candidate").select(F.col("question_id").alias("case_id"), "doc_id")
    runs = once(table(spark, d, "causal_score_row"), ["row_id"], [F.col("loaded_at").asc_nulls_last(), F.col("latency_ms").asc_nulls_last()]).withColumn("answer", F.when(F.col("verdict") == "SUPPORTED", F.col("status")).otherwise(F.lit("")))
    return X.answer_faults(runs, "row_id", "case_id", "evidence_document_ids", "verdict", "answer", given, "doc_id").groupBy("verdict", "fault").agg(F.count(F.lit(1)).alias("runs"))


QUERIES = {f.__name__: f for f in (alignment_terms, alignment_decisions, coverage_gaps, matched_removal, diverse_segments, wording_precedence, word_prefixes, audited_lines, answer_faults)}

_SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(trim({x}, ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
_T = f"""WITH o AS (SELECT DISTINCT lower(trim(source_system, ' ')) AS system, datatype AS object_type, predicate AS field FROM claim WHERE predicate IS NOT NULL),
h(surface, generic, domain, range) AS (VALUES {_values(_TERMS)}),
t AS (SELECT o.*, {_SLUG.format(x="field")} AS surface FROM o),
m AS (SELECT system, object_type, field, t.surface, CASE WHEN system = 'jira' AND object_type = 'string' AND t.surface = 'owner_team' THEN 'ASSIGNED_TO' ELSE coalesce(generic, 'UNMAPPED') END AS target FROM t LEFT JOIN h ON t.surface = h.surface)
"""
_BAND = """WITH dd AS (SELECT doc_id, source_object_id, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS n FROM documents),
s AS (SELECT DISTINCT unnest(source_object_ids) AS source_object_id FROM source_version_group),
c AS (SELECT question_id, doc_id, max(score) AS score FROM retrieval_candidate WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
b AS (SELECT question_id, doc_id, score, n // 50 AS tokens, source_object_id IN (SELECT source_object_id FROM s WHERE source_object_id IS NOT NULL) AS removed FROM c JOIN dd USING (doc_id)),
g AS (SELECT question_id, doc_id, tokens, row_number() OVER (PARTITION BY question_id, tokens ORDER BY doc_id) AS k FROM b WHERE score >= 0.3 AND removed),
p AS (SELECT question_id, doc_id, tokens, row_number() OVER (PARTITION BY question_id, tokens ORDER BY doc_id) AS k FROM b WHERE NOT removed AND NOT score >= 0.3)
SELECT g.question_id, g.doc_id, p.doc_id AS replacement FROM g LEFT JOIN p ON g.question_id IS NOT DISTINCT FROM p.question_id AND g.tokens = p.tokens AND g.k = p.k"""
SQL = {
    "alignment_terms": _T + "SELECT * FROM m",
    "alignment_decisions": _T + f""", u AS (SELECT DISTINCT generic AS target, domain, range FROM h), r(surface, rt, rd, rr) AS (VALUES {_values(_RULES)}),
      j AS (SELECT m.*, rt, CASE WHEN m.target <> rt THEN 'target_mismatch' WHEN u.domain IS DISTINCT FROM rd THEN 'domain_mismatch' WHEN u.range IS DISTINCT FROM rr THEN 'range_mismatch' END AS c FROM m LEFT JOIN u ON u.target = m.target LEFT JOIN r ON r.surface = m.surface)
      SELECT system, object_type, field, surface, target, CASE WHEN rt IS NULL THEN 'pending' WHEN c IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN rt IS NOT NULL THEN c END AS "constraint" FROM j""",
    "coverage_gaps": """WITH s AS (SELECT lower(trim(source_system, ' ')) AS system, extraction_method AS object_type, CASE WHEN count(*) FILTER (WHERE object_value IS NULL) > 0.2 * count(*) THEN 'failed' WHEN count(*) FILTER (WHERE object_value IS NULL) > 0.07 * count(*) THEN 'partial' ELSE 'complete' END AS status, list(DISTINCT predicate) AS predicates FROM claim GROUP BY 1, 2),
      q AS (SELECT DISTINCT lower(trim(source_system, ' ')) AS system, predicate, object_type FROM authority_policy, (SELECT unnest(['llm', 'structural', 'manual']) AS object_type))
      SELECT q.system, q.object_type, q.predicate, CASE WHEN s.status IS NULL THEN 'slice_missing' WHEN status = 'failed' THEN 'ingestion_failed' WHEN status = 'partial' THEN 'ingestion_incomplete' WHEN NOT list_contains(predicates, q.predicate) THEN 'predicate_not_examined' END AS gap FROM q LEFT JOIN s USING (system, object_type)""",
    "matched_removal": _BAND,
    "wording_precedence": "WITH t AS (SELECT source_type, coalesce(text, '') AS x FROM documents) SELECT source_type, (" + " + ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN {w} ELSE 0 END" for p, w in X.PRECEDENCE) + ")::INT AS precedence, count(*) AS documents FROM t GROUP BY 1, 2",
    "word_prefixes": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\s*\S+')[1:20], '') AS head FROM documents WHERE source_object_id IN (SELECT unnest(source_object_ids) FROM source_version_group)",
    "audited_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT doc_id, line::INT AS line, '{k}' AS kind FROM l WHERE regexp_matches(x, '{p}')" for k, p in X.SECRETS.items()),
    "answer_faults": """WITH g AS (SELECT question_id AS case_id, list(DISTINCT doc_id) AS supplied FROM retrieval_candidate GROUP BY 1),
      r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at) AS k FROM causal_score_row) WHERE k = 1)
      SELECT verdict, CASE WHEN len(list_filter(coalesce(evidence_document_ids, []), lambda x: x IS NOT NULL AND NOT list_contains(coalesce(supplied, []), x))) > 0 THEN 'cites_what_it_lacks' WHEN verdict = 'SUPPORTED' AND coalesce(length(trim(status, ' ')), 0) = 0 THEN 'says_nothing' END AS fault, count(*) AS runs FROM r LEFT JOIN g USING (case_id) GROUP BY 1, 2""",
}
