"""Retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import STOPWORDS, query_terms
from tessella.operators import retrieval as R
from tessella.plans import table

_TOP = 10


def _questions(spark, d):
    return table(spark, d, "conflict_case").where("question_id IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"))


def bm25_topk(spark, d):
    return R.bm25(_questions(spark, d), "question_id", query_terms(F.col("question")), table(spark, d, "documents"), "doc_id", ["title", "text"], _TOP)


def _hits(spark, d, *keep):
    return R.best_hits(_questions(spark, d), "question_id", "question", table(spark, d, "documents"), "doc_id", "title", "text", _TOP, keep)


def title_hits(spark, d):
    return R.ranked(_hits(spark, d), "question_id", "doc_id", "score", _TOP)


def source_diverse_topk(spark, d):
    return R.diverse(_hits(spark, d, "source_type"), "question_id", "doc_id", "source_type", "score", _TOP)


def _anchored(spark, d):
    docs = table(spark, d, "documents").select("source_object_id", "doc_id")
    sets = table(spark, d, "source_version_group").select("group_id", F.explode("source_object_ids").alias("source_object_id")).join(docs, "source_object_id")
    return sets, R.contained(sets, "group_id", "doc_id", table(spark, d, "retrieval_candidate"), "question_id")


def conflict_anchors(spark, d):
    """Groups of versions that a question's candidates hold wholly."""
    return _anchored(spark, d)[1]


def context_policy(spark, d):
    """Questions with exactly one such group: the version seen last is pinned, the others are removed."""
    sets, found = _anchored(spark, d)
    one = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("group_id")).where("n = 1")
    seen = sets.join(table(spark, d, "documents").select("doc_id", "observed_at"), "doc_id").groupBy("group_id").agg(F.max_by("doc_id", F.struct("observed_at", "doc_id")).alias("pinned"), F.count_distinct("doc_id").alias("versions"))
    return one.join(seen, "group_id").select("question_id", "group_id", "pinned", (F.col("versions") - 1).alias("removed"))


def text_segments(spark, d):
    """How many runs of one to three lines the texts of a source type have, and how long they are."""
    s = R.segments(table(spark, d, "documents").select("doc_id", "source_type", "text"), "doc_id", "text", keep=("source_type",))
    return s.groupBy("source_type", "width").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("segment")).alias("chars"))


def bounded_excerpts(spark, d):
    """Of each listed question's candidates an excerpt of 600 characters at most, and a line that denies."""
    q = _questions(spark, d).select("question_id", query_terms(F.col("question")).alias("terms"))
    c = table(spark, d, "retrieval_candidate").select("question_id", "doc_id").distinct().join(q, "question_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return c.select("question_id", "doc_id", R.excerpt(F.col("text"), F.col("terms"), 600).alias("excerpt"), R.contrast_line(F.col("text"), F.col("terms")).alias("contrast"))


QUERIES = {f.__name__: f for f in (bm25_topk, title_hits, source_diverse_topk, conflict_anchors, context_policy, text_segments, bounded_excerpts)}

_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
_Q = f"""WITH q AS (SELECT question_id, min(question) AS question FROM conflict_case WHERE question_id IS NOT NULL GROUP BY 1),
w AS (SELECT question_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_WORDS})) AS w FROM q),
f AS (SELECT question_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:24] AS t FROM w),
a AS (SELECT DISTINCT question_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE ['enterprise'] END) AS term FROM f),
"""
_HITS = _Q + """t AS (SELECT DISTINCT doc_id, term, 5 AS p FROM (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM documents)),
b AS (SELECT doc_id, term, least(3, count(*)) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
s AS (SELECT question_id, doc_id, sum(p)::BIGINT AS score FROM a JOIN (SELECT * FROM t UNION ALL SELECT * FROM b) USING (term) GROUP BY ALL)
"""
_SETS = "WITH s AS (SELECT DISTINCT group_id, doc_id FROM (SELECT group_id, unnest(source_object_ids) AS source_object_id FROM source_version_group) JOIN documents USING (source_object_id) WHERE doc_id IS NOT NULL), n AS (SELECT group_id, count(*) AS size FROM s GROUP BY 1), f AS (SELECT question_id, group_id FROM (SELECT DISTINCT question_id, doc_id FROM retrieval_candidate) JOIN s USING (doc_id) JOIN n USING (group_id) GROUP BY question_id, group_id, size HAVING count(*) = size) "
SQL = {
    "bm25_topk": _Q + f"""d AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', title, text)), '[a-z0-9]+') AS w FROM documents),
      l AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
      p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY ALL),
      o AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
      s AS (SELECT question_id, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM a JOIN o USING (term) JOIN p USING (term), l GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::INT AS place FROM s) WHERE place <= {_TOP}""",
    "title_hits": _HITS + f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::INT AS place FROM s) WHERE place <= {_TOP}",
    "source_diverse_topk": _HITS + f", o AS (SELECT s.*, source_type, row_number() OVER (PARTITION BY question_id, source_type ORDER BY score DESC, doc_id) AS own FROM s JOIN documents USING (doc_id)), r AS (SELECT question_id, doc_id, source_type, score, row_number() OVER (PARTITION BY question_id ORDER BY own > 1, score DESC, doc_id)::INT AS place FROM o) SELECT * FROM r WHERE place <= {_TOP}",
    "conflict_anchors": _SETS + "SELECT question_id, group_id FROM f",
    "context_policy": _SETS + ", o AS (SELECT question_id, min(group_id) AS group_id FROM f GROUP BY 1 HAVING count(*) = 1), v AS (SELECT group_id, first(doc_id ORDER BY observed_at DESC NULLS LAST, doc_id DESC) AS pinned, count(DISTINCT doc_id) AS versions FROM s JOIN documents USING (doc_id) GROUP BY 1) SELECT question_id, group_id, pinned, versions - 1 AS removed FROM o JOIN v USING (group_id)",
    "text_segments": r"""WITH l AS (SELECT source_type, list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ') <> '') AS l FROM documents WHERE text IS NOT NULL),
      s AS (SELECT source_type, width, array_to_string(l[i + 1:i + width], chr(10)) AS s FROM l, (SELECT unnest([1, 2, 3])::INT AS width), range(0, greatest(len(l) - width + 1, 0)) r(i))
      SELECT source_type, width, count(*) AS segments, sum(length(s))::BIGINT AS chars FROM s GROUP BY ALL""",
}
