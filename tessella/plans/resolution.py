"""Identities: from observations to decisions and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import identity
from tessella.operators.components import connected_components
from tessella.plans import table
from tessella.staging import stage


def _observations(spark, d):
    """object, kind, namespace, value of review_source's identifiers."""
    r = table(spark, d, "review_source")
    x = r.select(F.col("source_object_id").alias("object"), F.explode("external_identifiers").alias("x"))
    kind = F.when(F.col("x.namespace").endswith("address"), "email").when(F.col("x.namespace").rlike("(login|handle)$"), "handle").when(F.col("x.namespace").rlike("(person|contact|user|account)$"), "external_id")
    given = x.select("object", kind.alias("kind"), F.col("x.namespace").alias("namespace"), F.col("x.value").alias("value")).where("kind IS NOT NULL")
    names = r.select(F.col("source_object_id").alias("object"), F.lit("name").alias("kind"), F.col("source_system").alias("namespace"), F.col("name").alias("value"))
    return given.unionByName(names)


def identity_keys(spark, d):
    return identity.identity_keys(_observations(spark, d)).groupBy("kind", "scope").agg(F.count_distinct("object").alias("objects"), F.count_distinct("value").alias("values"))


def _decided(spark, d):
    keys = stage(identity.identity_keys(_observations(spark, d)), "keys")
    found = stage(identity.signals(keys), "signals")
    return keys, identity.decide(found, identity.constraints(found, keys))


def identity_signals(spark, d):
    return identity.signals(identity.identity_keys(_observations(spark, d)))


def identity_decisions(spark, d):
    return _decided(spark, d)[1].select("left", "right", "status", F.round("confidence", 6).alias("confidence"), F.array_join("signals", ",").alias("signals"), F.array_join("constraints", ",").alias("constraints"))


def canonical_entities(spark, d):
    """Entities over names alone: pending pairs taken as accepted, to have groups of several objects."""
    keys, decided = _decided(spark, d)
    taken = decided.where("status <> 'rejected'").withColumn("status", F.lit("accepted"))
    return identity.entities(taken, keys.select("object").distinct())


def vetoed_merges(spark, d):
    keys, decided = _decided(spark, d)
    return identity.vetoed_merge(decided.where("status <> 'rejected'").withColumn("status", F.lit("accepted")), keys)


def _logged(spark, d):
    ids = F.col("candidate_source_object_ids")
    clean = lambda x: F.lower(F.trim(x))
    two = table(spark, d, "identity_decision").where(F.size(ids) == 2)
    return two.select(F.col("decision_id").alias("decision"), F.least(clean(ids[0]), clean(ids[1])).alias("left"), F.greatest(clean(ids[0]), clean(ids[1])).alias("right"), F.regexp_replace(F.lower("status"), r"\s", "").alias("status"), F.col("decided_at").alias("at")).where("left <> right AND left <> ''").distinct()


def active_decisions(spark, d):
    return identity.active_decisions(_logged(spark, d)).select("decision", "left", "right", "status")


def reversed_entities(spark, d):
    """Entities over the decisions that hold after all reversals."""
    held = stage(identity.active_decisions(_logged(spark, d)).where("status = 'accepted'"), "held")
    return connected_components(held, "left", "right").select(F.col("vertex").alias("object"), F.col("component").alias("entity"))


def decision_counts(spark, d):
    x = _logged(spark, d)
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return x.groupBy("left", "right").agg(*(one(s) for s in ("accepted", "rejected", "pending", "reversed"))).groupBy((F.col("accepted") > 0).alias("ever_accepted"), (F.col("reversed") > 0).alias("ever_reversed")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("pending").alias("pending"))


def review_set(spark, d):
    return identity.review_order(identity.active_decisions(_logged(spark, d)), 25)


QUERIES = {f.__name__: f for f in (identity_keys, identity_signals, identity_decisions, canonical_entities, vetoed_merges, active_decisions, reversed_entities, decision_counts, review_set)}

_KEYS = """WITH RECURSIVE o AS (
  SELECT source_object_id AS object, CASE WHEN x.namespace LIKE '%address' THEN 'email' WHEN regexp_matches(x.namespace, '(login|handle)$') THEN 'handle' WHEN regexp_matches(x.namespace, '(person|contact|user|account)$') THEN 'external_id' END AS kind, x.namespace AS namespace, x.value AS value
  FROM (SELECT source_object_id, unnest(external_identifiers) AS x FROM review_source)
  UNION ALL SELECT source_object_id, 'name', source_system, name FROM review_source),
k AS (SELECT DISTINCT object, kind, CASE WHEN kind IN ('email', 'name') THEN 'global' ELSE lower(trim(namespace, ' ')) END AS scope, lower(trim(value, ' ')) AS value FROM o WHERE kind IS NOT NULL AND object IS NOT NULL AND trim(value, ' ') <> ''),
s AS (SELECT a.object AS l, b.object AS r, a.kind, min(a.value) AS value FROM k a JOIN k b ON a.kind = b.kind AND a.scope = b.scope AND a.value = b.value AND a.object < b.object GROUP BY ALL),
p AS (SELECT DISTINCT l, r FROM s),
both_ AS (SELECT l, r, a.kind, a.scope, bool_or(a.value = b.value) AS shared FROM p JOIN k a ON a.object = l JOIN k b ON b.object = r AND a.kind = b.kind AND a.scope = b.scope WHERE a.kind IN ('email', 'external_id') GROUP BY ALL),
c AS (SELECT l, r, CASE WHEN kind = 'email' THEN 'email_conflict' ELSE 'identifier_conflict:' || scope END AS c FROM both_ WHERE NOT shared),
cs AS (SELECT l, r, string_agg(DISTINCT c, ',' ORDER BY c) AS constraints FROM c GROUP BY ALL),
d AS (SELECT l, r, string_agg(DISTINCT kind, ',' ORDER BY kind) AS signals, avg(CASE WHEN kind = 'name' THEN 0.35 ELSE 1.0 END) AS w, bool_or(kind <> 'name') AS v FROM s GROUP BY ALL),
z AS (SELECT l, r, CASE WHEN constraints IS NOT NULL THEN 'rejected' WHEN v THEN 'accepted' ELSE 'pending' END AS status, w, signals, coalesce(constraints, '') AS constraints FROM d LEFT JOIN cs USING (l, r))
"""
_LOGGED = r"""WITH RECURSIVE x AS (
  SELECT DISTINCT decision_id AS decision, least(lower(trim(candidate_source_object_ids[1], ' ')), lower(trim(candidate_source_object_ids[2], ' '))) AS l, greatest(lower(trim(candidate_source_object_ids[1], ' ')), lower(trim(candidate_source_object_ids[2], ' '))) AS r,
         regexp_replace(lower(status), '\s', '', 'g') AS status, decided_at AS decided, candidate_source_object_ids AS ids
  FROM identity_decision WHERE len(candidate_source_object_ids) = 2),
y AS (SELECT DISTINCT decision, l, r, status, decided FROM x WHERE l <> r AND l <> '' AND ids[1] IS NOT NULL AND ids[2] IS NOT NULL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY decided DESC NULLS LAST, decision DESC) AS k FROM y) WHERE k = 1 AND status <> 'reversed')
"""
_REACH = """, e AS (SELECT l AS a, r AS b FROM {src} UNION SELECT r, l FROM {src}), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)"""
SQL = {
    "identity_keys": _KEYS + "SELECT kind, scope, count(DISTINCT object) AS objects, count(DISTINCT value) AS values FROM k GROUP BY ALL",
    "identity_signals": _KEYS + 'SELECT l AS "left", r AS "right", kind, value FROM s',
    "identity_decisions": _KEYS + "SELECT l AS \"left\", r AS \"right\", status, CASE status WHEN 'rejected' THEN 0.0 WHEN 'accepted' THEN 1.0 ELSE round(least(0.89, w), 6) END::DOUBLE AS confidence, signals, constraints FROM z",
    "canonical_entities": _KEYS + _REACH.format(src="(SELECT l, r FROM z WHERE status <> 'rejected')") + ", g AS (SELECT a, least(a, min(b)) AS m FROM w GROUP BY a) SELECT object, 'entity_' || substr(sha256('entity' || chr(0) || coalesce(m, object)), 1, 24) AS entity FROM (SELECT DISTINCT object FROM k) LEFT JOIN g ON a = object",
    "active_decisions": _LOGGED + 'SELECT decision, l AS "left", r AS "right", status FROM a',
    "reversed_entities": _LOGGED + _REACH.format(src="(SELECT l, r FROM a WHERE status = 'accepted')") + " SELECT a AS object, least(a, min(b)) AS entity FROM w GROUP BY a",
    "decision_counts": _LOGGED + "SELECT ac > 0 AS ever_accepted, rv > 0 AS ever_reversed, count(*) AS pairs, sum(pe)::BIGINT AS pending FROM (SELECT l, r, count(*) FILTER (WHERE status = 'accepted') AS ac, count(*) FILTER (WHERE status = 'reversed') AS rv, count(*) FILTER (WHERE status = 'pending') AS pe FROM y GROUP BY l, r) GROUP BY ALL",
    "review_set": _LOGGED + 'SELECT l AS "left", r AS "right", status, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY l, r) AS place FROM a) WHERE place <= 25',
}
