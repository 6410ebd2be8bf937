"""Intake of documents: identifiers, checks, coverage, ledgers, versions and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.ids import canonical_json, hash_share, int_id, stable_id
from tessella.functions.text import anchors, collapsed, latest_date, percentage, query_terms, singular, slug, version_rank
from tessella.operators import intake
from tessella.plans import table


def _checked(spark, d):
    """Documents with the reason for which each is rejected."""
    fine = [("invalid_id", intake.required("source_native_id", "source_object_id")), ("invalid_title", intake.required("title")), ("invalid_content", F.length(F.trim("text")) > 0)]
    return table(spark, d, "documents").withColumn("reason", intake.rejected_for(fine))


def stable_ids(spark, d):
    made = stable_id("document", canonical_json({"native": F.col("source_native_id"), "system": F.col("source_type")}))
    return table(spark, d, "documents").select("doc_id", made.alias("stable_id"), int_id(F.col("source_object_id")).alias("int_id"))


def normalized_objects(spark, d):
    kept = _checked(spark, d).where("reason IS NULL")
    return intake.source_objects(kept, "source_type", "source", "source_native_id", "payload_digest").select("doc_id", "object_id", "source_type", F.sha2("text", 256).alias("content_digest"), F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_digest"))


def reject_invalid_records(spark, d):
    return _checked(spark, d).where("reason IS NOT NULL").select("doc_id", "reason")


def coverage_slices(spark, d):
    c = _checked(spark, d)
    return intake.coverage(c.where("reason IS NULL"), c.where("reason IS NOT NULL"), "source_type")


def ingestion_ledger(spark, d):
    c = _checked(spark, d).withColumn("run", F.lit("first"))
    again = c.unionByName(c.where("lang = 'en'")).withColumn("run", F.lit("second"))
    return intake.ledger(c.unionByName(again), "run", "source_type", "source_native_id", "payload_digest", "reason")


def acquired_documents(spark, d):
    wanted = table(spark, d, "retrieval_candidate")
    have, lack = intake.acquire(table(spark, d, "documents"), wanted, "doc_id", "payload_digest")
    return have.select("doc_id", F.lit(True).alias("found")).unionByName(lack.select("doc_id", F.lit(False).alias("found")))


def source_versions(spark, d):
    return intake.version_groups(table(spark, d, "documents"), "source_type", "source_native_id", "payload_digest", "source_object_id")


def repeated_texts(spark, d):
    same = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest"))
    return same.agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def corpus_counts(spark, d):
    c = table(spark, d, "documents")
    null = lambda x: F.count_if(F.col(x).isNull()).alias(f"null_{x}")
    return c.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("containers"), F.count_distinct("source", "lang").alias("container_languages"), null("text"), null("lang"), null("title"), F.sum("n_chars").alias("chars"))


def duplicate_classes(spark, d):
    return intake.duplicate_pairs(table(spark, d, "documents"), "source_object_id", "source_type", "source_native_id", "payload_digest", "text")


def version_links(spark, d):
    """All links between the payloads of a native id; ``source_type`` is both the system and the type of a document."""
    return intake.version_links(table(spark, d, "documents"), "source_type", "source_type", "source_native_id", "payload_digest", "source_object_id")


def payload_members(spark, d):
    return intake.payload_members(table(spark, d, "documents"), "source_type", "source_type", "source_native_id", "payload_digest", "source_object_id").select("source_object_id", "representative")


def latest_versions(spark, d):
    order = [F.col("observed_at").desc_nulls_last(), F.col("source_object_id").asc()]
    return intake.once(table(spark, d, "documents").where("source_native_id IS NOT NULL"), ["source_type", "source_native_id"], order).select("source_type", "source_native_id", "source_object_id")


def question_terms(spark, d):
    q = table(spark, d, "conflict_case").select("question_id", "question").distinct()
    terms = query_terms(F.col("question"))
    return q.select("question_id", F.array_join(terms, " ").alias("terms"), F.array_join(F.transform(terms, singular), " ").alias("singular"), F.array_join(anchors(F.col("question")), " ").alias("anchors"))


def text_facts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", percentage(t).alias("percentage"), latest_date(t).alias("latest_date"), F.size(anchors(F.coalesce(t, F.lit("")))).alias("anchors"))


def claim_slugs(spark, d):
    c = table(spark, d, "claim")
    return c.groupBy(slug(F.col("predicate")).alias("predicate")).agg(F.count(F.lit(1)).alias("claims"), F.count_distinct(collapsed(F.col("object_value"))).alias("values"), F.max(version_rank(F.col("extractor_version"))).alias("newest"))


def event_fields(spark, d):
    """Fields out of JSON text; what isn't an object with a number is left out."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").where(k.isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("total"), F.count_distinct(k).alias("different"))


def sampled_documents(spark, d):
    """A repeatable hundredth of the documents: a sampling operator."""
    return table(spark, d, "documents").where(hash_share(F.col("source_object_id"), "sample", 100) == 7).select("doc_id", "source_object_id")


def salted_choice(spark, d):
    """Of each source type the document and two decoys that come first by salted hash."""
    c = table(spark, d, "documents").select("source_type", "source_object_id", F.sha2(F.concat(F.lit("holdout|"), "source_type", F.lit("|"), "source_object_id"), 256).alias("h"))
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("source_type").orderBy("h", "source_object_id"))
    return c.withColumn("place", r).where("place <= 3").select("source_type", "source_object_id", "place")


QUERIES = {f.__name__: f for f in (stable_ids, normalized_objects, reject_invalid_records, coverage_slices, ingestion_ledger, acquired_documents, source_versions, repeated_texts, corpus_counts, duplicate_classes, version_links, payload_members, latest_versions, question_terms, text_facts, claim_slugs, event_fields, sampled_documents, salted_choice)}

_JSON = "CASE WHEN {x} IS NULL THEN 'null' ELSE CAST(to_json({x}) AS VARCHAR) END"
_OK = "length(source_native_id) > 0 AND length(source_object_id) > 0"
_CHECKED = f"""WITH c AS (SELECT *, CASE WHEN NOT coalesce({_OK}, false) THEN 'invalid_id' WHEN NOT coalesce(length(title) > 0, false) THEN 'invalid_title'
  WHEN NOT coalesce(length(trim(text, ' ')) > 0, false) THEN 'invalid_content' END AS reason FROM documents)"""
_WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_COLLAPSE = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' '))"
_SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(trim({x}, ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_ANCHORS = "list_distinct(regexp_extract_all({x}, '[A-Z][A-Z0-9]+-[0-9]+|v[0-9]+(?:\\.[0-9]+)+|[0-9a-f]{{7,}}'))"


def _words_list() -> str:
    from tessella.functions.text import STOPWORDS

    return ", ".join(f"'{w}'" for w in STOPWORDS)


_TERMS = f"""WITH q AS (SELECT DISTINCT question_id, question FROM conflict_case),
w AS (SELECT question_id, question, list_filter({_WORDS.format(x="question")}, lambda x: length(x) > 1 AND x NOT IN ({_words_list()})) AS w FROM q),
k AS (SELECT question_id, question, list_filter(w, lambda x, i: list_position(w, x) = i)[1:24] AS t,
             regexp_extract_all(question, '[A-Z][A-Z0-9]+-[0-9]+|v[0-9]+(?:\\.[0-9]+)+|[0-9a-f]{{7,}}') AS a FROM w),
t AS (SELECT *, CASE WHEN len(t) > 0 THEN t ELSE ['enterprise'] END AS u FROM k)
SELECT question_id, array_to_string(u, ' ') AS terms,
       array_to_string(list_transform(u, lambda x: CASE WHEN regexp_matches(x, '[^aeiou]ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '[^s]s$') AND length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END), ' ') AS singular,
       coalesce(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' '), '') AS anchors FROM t"""
_LEDGER = _CHECKED + """,
r AS (SELECT 'first' AS run, * FROM c UNION ALL SELECT 'second', * FROM c UNION ALL SELECT 'second', * FROM c WHERE lang = 'en'),
f AS (SELECT run, source_type, source_native_id, payload_digest, count(*) AS n FROM r WHERE reason IS NULL GROUP BY ALL),
m AS (SELECT run, source_type, source_native_id, count(*) AS digests, sum(n) AS n FROM f GROUP BY ALL),
g AS (SELECT run, source_type, sum(digests) AS accepted, sum(n - digests) AS skipped, count(*) AS natives, count(*) FILTER (WHERE digests > 1) AS divergent FROM m GROUP BY ALL),
b AS (SELECT run, source_type, count(*) AS rejected FROM r WHERE reason IS NOT NULL GROUP BY ALL)
SELECT run, source_type, coalesce(accepted, 0)::BIGINT AS accepted, coalesce(skipped, 0)::BIGINT AS skipped, coalesce(rejected, 0) AS rejected, coalesce(natives, 0) AS natives, coalesce(divergent, 0) AS divergent
FROM g FULL JOIN b USING (run, source_type)"""
_DUPLICATES = f"""WITH b AS (SELECT source_object_id AS id, source_type AS kind, source_native_id AS native, payload_digest AS digest, {_COLLAPSE.format(x="text")} AS body FROM documents),
p AS (SELECT min(id) OVER (PARTITION BY digest) AS l, id AS r, 1 AS o, 'exact' AS class FROM b WHERE digest IS NOT NULL
      UNION ALL SELECT min(id) OVER (PARTITION BY kind, native), id, 2, 'version_candidate' FROM b WHERE native IS NOT NULL AND kind IS NOT NULL
      UNION ALL SELECT min(id) OVER (PARTITION BY kind, body), id, 3, 'near' FROM b WHERE kind IS NOT NULL AND body IS NOT NULL)
SELECT l AS "left", r AS "right", arg_min(class, o) AS class FROM p WHERE l < r GROUP BY l, r"""
SQL = {
    "stable_ids": f"""SELECT doc_id, 'document_' || substr(sha256('document' || chr(0) || '{{"native":' || {_JSON.format(x="source_native_id")} || ',"system":' || {_JSON.format(x="source_type")} || '}}'), 1, 24) AS stable_id,
      ('0x' || substr(sha256(source_object_id), 1, 13))::BIGINT AS int_id FROM documents""",
    "normalized_objects": _CHECKED + f""" SELECT doc_id, 'source_object_' || substr(sha256('source_object' || chr(0) || '{{"digest":' || {_JSON.format(x="payload_digest")} || ',"kind":' || {_JSON.format(x="source")} || ',"native":' || {_JSON.format(x="source_native_id")} || ',"system":' || {_JSON.format(x="source_type")} || '}}'), 1, 24) AS object_id,
      source_type, sha256(text) AS content_digest, sha256(coalesce(title, '')) AS title_digest FROM c WHERE reason IS NULL""",
    "reject_invalid_records": _CHECKED + " SELECT doc_id, reason FROM c WHERE reason IS NOT NULL",
    "coverage_slices": _CHECKED + " SELECT source_type, count(*) AS objects, CASE WHEN (SELECT count(*) FROM c WHERE reason IS NOT NULL) > 0 THEN 'partial' ELSE 'complete' END AS status FROM c WHERE reason IS NULL GROUP BY source_type",
    "ingestion_ledger": _LEDGER,
    "acquired_documents": "WITH w AS (SELECT DISTINCT doc_id FROM retrieval_candidate WHERE doc_id IS NOT NULL) SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS found FROM w",
    "source_versions": """WITH v AS (SELECT source_type, source_native_id, payload_digest, min(source_object_id) AS source_object_id FROM documents WHERE source_native_id IS NOT NULL AND payload_digest IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, count(*) OVER w AS versions, first_value(source_object_id) OVER (w ORDER BY payload_digest) AS anchor_item FROM v WINDOW w AS (PARTITION BY source_type, source_native_id))
      SELECT *, source_object_id = anchor_item AS is_anchor FROM g WHERE versions > 1""",
    "repeated_texts": "SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "corpus_counts": """SELECT source_type, count(*) AS documents, count(DISTINCT source) AS containers, count(DISTINCT CASE WHEN source IS NOT NULL AND lang IS NOT NULL THEN (source, lang) END) AS container_languages,
      count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE lang IS NULL) AS null_lang, count(*) FILTER (WHERE title IS NULL) AS null_title, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source_type""",
    "duplicate_classes": _DUPLICATES,
    "version_links": """WITH p AS (SELECT source_type, source_native_id, payload_digest, min(source_object_id) AS id FROM documents WHERE source_type IS NOT NULL AND source_native_id IS NOT NULL AND payload_digest IS NOT NULL GROUP BY ALL)
      SELECT l.source_type, l.source_native_id, least(l.id, r.id) AS "left", greatest(l.id, r.id) AS "right" FROM p l JOIN p r ON l.source_type = r.source_type AND l.source_native_id = r.source_native_id AND l.payload_digest < r.payload_digest""",
    "payload_members": "SELECT source_object_id, min(source_object_id) OVER (PARTITION BY source_type, source_native_id, payload_digest) AS representative FROM documents WHERE source_type IS NOT NULL AND source_native_id IS NOT NULL AND payload_digest IS NOT NULL",
    "latest_versions": "SELECT source_type, source_native_id, first(source_object_id ORDER BY observed_at DESC NULLS LAST, source_object_id) AS source_object_id FROM documents WHERE source_native_id IS NOT NULL GROUP BY ALL",
    "question_terms": _TERMS,
    "text_facts": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?) ?%', 1) AS p, regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS ds, {_ANCHORS.format(x="coalesce(text, '')")} AS a FROM documents)
      SELECT doc_id, CASE WHEN len(p) = 1 THEN p[1]::DOUBLE END AS percentage, list_max(list_transform(ds, lambda x: try_cast(x AS DATE))) AS latest_date, len(a)::INT AS anchors FROM t""",
    "claim_slugs": f"""SELECT {_SLUG.format(x="predicate")} AS predicate, count(*) AS claims, count(DISTINCT {_COLLAPSE.format(x="object_value")}) AS values,
      max(coalesce(try_cast(regexp_extract(extractor_version, '([0-9]+)$', 1) AS INT), 0)) AS newest FROM claim GROUP BY 1""",
    "event_fields": "WITH e AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS events, sum(k)::BIGINT AS total, count(DISTINCT k) AS different FROM e WHERE k IS NOT NULL GROUP BY event_type",
    "sampled_documents": "SELECT doc_id, source_object_id FROM documents WHERE ('0x' || substr(sha256('sample|' || source_object_id), 1, 8))::BIGINT % 100 = 7",
    "salted_choice": """WITH r AS (SELECT source_type, source_object_id, row_number() OVER (PARTITION BY source_type ORDER BY sha256('holdout|' || source_type || '|' || source_object_id), source_object_id)::INT AS place FROM documents)
      SELECT * FROM r WHERE place <= 3""",
}
