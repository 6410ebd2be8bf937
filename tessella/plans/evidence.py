"""The evidence graph over claims, policies, documents and identity decisions, and its reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import evidence as E
from tessella.operators.graph import union
from tessella.plans import table
from tessella.staging import stage


def _compared(spark, d):
    """conflict, l, r, resolution of logged comparisons; the conflict is named by its two claims."""
    c = table(spark, d, "claim").where("compared_claim_id IS NOT NULL")
    return c.select(F.concat_ws("|", F.lit("conflict"), "claim_id", "compared_claim_id").alias("conflict"), F.col("claim_id").alias("l"), F.col("compared_claim_id").alias("r"), F.lower(F.trim("comparison_resolution")).alias("resolution"), F.lower(F.trim("source_system")).alias("system"), F.lower(F.trim("predicate")).alias("predicate")).distinct()


def _policies(spark, d):
    return table(spark, d, "authority_policy").groupBy(F.lower(F.trim("predicate")).alias("predicate"), F.lower(F.trim("source_system")).alias("system")).agg(F.min("policy_id").alias("policy"))


def _decisions(spark, d):
    x = table(spark, d, "identity_decision").where("decision_id IS NOT NULL")
    one = x.groupBy("decision_id").agg(F.min_by(F.struct("candidate_source_object_ids", "signals", "constraints", "decided_at"), F.struct("decided_at", "status")).alias("x"))
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("x.candidate_source_object_ids", lambda i: i.isNotNull()), lambda i: F.lower(F.trim(i)))))
    return one.select("decision_id", ids.alias("ids"), F.col("x.signals").alias("signals"), F.col("x.constraints").alias("constraints"), F.col("x.decided_at").alias("at"))


def _superseding(spark, d):
    """decision, former: of the decisions of one set of objects each and the one before it."""
    k = Window.partitionBy("ids").orderBy("at", "decision_id")
    return _decisions(spark, d).where("size(ids) > 1").withColumn("former", F.lag("decision_id").over(k)).where("former IS NOT NULL").select("decision_id", "former")


def _nodes(spark, d):
    c, u = table(spark, d, "claim"), _decisions(spark, d)
    return union([
        E.node(c, "Claim", "claim_id"), E.node(c, "Entity", "subject_entity_id"), E.node(table(spark, d, "documents"), "SourceObject", "source_object_id"), E.node(table(spark, d, "authority_policy"), "Policy", "policy_id"), E.node(_compared(spark, d), "Conflict", "conflict"),
        E.node(c, "Observation", F.concat(F.lit("obs|"), "claim_id")), E.node(u, "Decision", "decision_id"), E.node(u.select(F.explode("ids").alias("i")), "Identity", "i"), E.node(u.select(F.explode("signals").alias("i")), "Signal", "i"), E.node(u.select(F.explode("constraints").alias("i")), "Constraint", "i"),
    ])


def _edges(spark, d):
    c, x, u = table(spark, d, "claim"), _compared(spark, d), _decisions(spark, d)
    settled = x.where("resolution IN ('left', 'right')").join(table(spark, d, "claim").groupBy(F.col("claim_id").alias("w")).agg(F.min(F.lower(F.trim("source_system"))).alias("ws")), F.col("w") == F.when(F.col("resolution") == "left", F.col("l")).otherwise(F.col("r")))
    decided = settled.select("conflict", "predicate", F.col("ws").alias("system")).join(_policies(spark, d), ["predicate", "system"])
    return union([
        E.edge(c, "ASSERTS", "subject_entity_id", "claim_id"), E.edge(c, "OBSERVED_AS", "claim_id", F.concat(F.lit("obs|"), "claim_id")), E.edge(c, "OBSERVED_IN", F.concat(F.lit("obs|"), "claim_id"), "source_object_id"), E.edge(c, "SUPPORTED_BY", "claim_id", "source_object_id"),
        E.edge(c, "RESOLVES_TO", "source_object_id", "subject_entity_id"), E.edge(x, "CONSIDERS", "conflict", "l", F.lit("left")), E.edge(x, "CONSIDERS", "conflict", "r", F.lit("right")), E.edge(decided, "DECIDED_BY", "conflict", "policy"),
        E.edge(u.select("decision_id", F.explode("ids").alias("i")), "CONSIDERS", "decision_id", "i"), E.edge(u.select("decision_id", F.explode("signals").alias("i")), "SUPPORTED_BY", "decision_id", "i"), E.edge(u.select("decision_id", F.explode("constraints").alias("i")), "BLOCKED_BY", "decision_id", "i"), E.edge(_superseding(spark, d), "SUPERSEDES", "decision_id", "former"),
    ])


def evidence_nodes(spark, d):
    return _nodes(spark, d)


def evidence_edges(spark, d):
    return _edges(spark, d)


def evidence_faults(spark, d):
    """What the graph lacks, together with listed questions and the documents retrieved for any: some of those aren't listed."""
    asked, found = table(spark, d, "conflict_case"), table(spark, d, "retrieval_candidate").join(table(spark, d, "documents").select("doc_id", "source_object_id"), "doc_id")
    return E.faults(_nodes(spark, d).unionByName(E.node(asked, "Question", "question_id")), _edges(spark, d).unionByName(E.edge(found, "RETRIEVED", "question_id", "source_object_id")))


def observation_evidence(spark, d):
    return E.observation_evidence(stage(_edges(spark, d).where("type IN ('ASSERTS', 'OBSERVED_AS', 'OBSERVED_IN')"), "edges"))


def conflict_reads(spark, d):
    """Every logged conflict with its sides, its policy and its winner, and what is wrong with it."""
    e = stage(_edges(spark, d).where("type IN ('CONSIDERS', 'DECIDED_BY')"), "edges")
    r = _compared(spark, d).groupBy("conflict").agg(F.min("resolution").alias("resolution"))
    return E.conflict_decisions(e, r)


def identity_reads(spark, d):
    found = E.identity_decisions(_edges(spark, d).where(F.col("type").isin("CONSIDERS", "SUPPORTED_BY", "BLOCKED_BY", "SUPERSEDES") & F.col("role").isNull()))
    own = _decisions(spark, d).select(F.col("decision_id").alias("decision"))
    return found.join(own, "decision", "left_semi").select("decision", *(F.array_join(c, ",").alias(c) for c in ("considers", "supported_by", "blocked_by", "supersedes")))


def resolved_sources(spark, d):
    """The one entity of every document that a claim rests on; several are a fault, and so is none."""
    return E.resolved_entities(_edges(spark, d).where("type = 'RESOLVES_TO'"), table(spark, d, "documents"), "source_object_id").groupBy("fault").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("entity").alias("entities"))


def source_claims(spark, d):
    """Claims by predicate of the sources in groups of versions, looked up all at once."""
    asked = table(spark, d, "source_version_group").select(F.explode("source_object_ids").alias("dst")).distinct()
    found = _edges(spark, d).where("type = 'SUPPORTED_BY' AND role IS NULL").join(asked, "dst", "left_semi").select(F.col("src").alias("claim_id"), F.col("dst").alias("source_object_id"))
    return found.join(table(spark, d, "claim").select("claim_id", "predicate").distinct(), "claim_id").select("source_object_id", "predicate", "claim_id")


def entity_presence(spark, d):
    """Which of the claims that others are compared with exist."""
    asked = _compared(spark, d).select(F.col("r").alias("id")).distinct()
    return asked.join(_nodes(spark, d).where("label = 'Claim'").select("id", F.lit(True).alias("present")), "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def version_relations(spark, d):
    """Pairs of documents of one system and native id, earlier one first, as their observation orders them."""
    x = table(spark, d, "documents").select("source_type", "source_native_id", "source_object_id", "observed_at", "payload_digest").where("source_native_id IS NOT NULL AND source_type IS NOT NULL")
    side = lambda p: x.select("source_type", "source_native_id", *(F.col(c).alias(f"{p}_{c}") for c in ("source_object_id", "observed_at", "payload_digest")))
    kind = F.when(F.col("l_payload_digest").eqNullSafe(F.col("r_payload_digest")), "same_payload").when(F.col("l_observed_at").isNull() | F.col("r_observed_at").isNull() | (F.col("l_observed_at") == F.col("r_observed_at")), "unordered").when(F.col("l_observed_at") < F.col("r_observed_at"), "precedes").otherwise("follows")
    return side("l").join(side("r"), ["source_type", "source_native_id"]).where("l_source_object_id < r_source_object_id").select(F.col("l_source_object_id").alias("left"), F.col("r_source_object_id").alias("right"), kind.alias("relation"))


def _ends(spark, d):
    """Entities of decided conflicts, and the policies that decided a conflict about one of their claims."""
    e = stage(_edges(spark, d), "edges")
    about = E.hop(E.hop(e.where("type = 'ASSERTS'").select(F.col("src").alias("start"), F.col("dst").alias("claim")), e, "CONSIDERS", "claim", "conflict", back=True), e, "DECIDED_BY", "conflict", "end")
    turned = e.where("type = 'CONSIDERS' AND role IS NOT NULL").select(F.lit("CONSIDERED_BY").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "role")
    return e.unionByName(turned), about.select("start", "end").distinct()


_PATH = ["ASSERTS", "CONSIDERED_BY", "DECIDED_BY"]


def policy_paths(spark, d):
    """Whole paths from entities to the policies that decided about their claims: two of each pair at most."""
    edges, pairs = _ends(spark, d)
    return E.paths(pairs, edges, _PATH, 3, 2).select("start", "end", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"), "place")


def requested_paths(spark, d):
    """One path for each of many requested pairs; every entity is asked for with the first policy, so some are missing."""
    edges, pairs = _ends(spark, d)
    first = table(spark, d, "authority_policy").agg(F.min("policy_id").alias("end"))
    asked = pairs.unionByName(table(spark, d, "claim").select(F.col("subject_entity_id").alias("start")).where("start IS NOT NULL").distinct().crossJoin(F.broadcast(first))).distinct()
    found = E.requested_paths(asked, E.paths(asked, edges, _PATH, 3, 1))
    return found.select("start", "end", F.coalesce("hops", F.lit(0)).alias("hops"), F.array_join("nodes", ">").alias("nodes"))


def path_sequences(spark, d):
    """Of every claim the source by its one observation; a claim of several sources is ambiguous."""
    start = table(spark, d, "claim").select(F.col("claim_id").alias("id")).where("id IS NOT NULL").distinct()
    found = E.sequence(start, _edges(spark, d).where("type IN ('OBSERVED_AS', 'OBSERVED_IN')"), ["OBSERVED_AS", "OBSERVED_IN"])
    return found.select("start", F.array_join("nodes", ">").alias("nodes"), "fault")


def path_proofs(spark, d):
    """Paths that must lead from an entity to a policy in three hops, checked; and those of other lengths and labels, which fail."""
    edges, pairs = _ends(spark, d)
    found = E.paths(pairs, edges, _PATH, 3, 1)
    short = E.paths(edges.where("type = 'ASSERTS'").select(F.col("src").alias("start"), F.col("dst").alias("end")), edges, ["ASSERTS"], 1, 1)
    nodes = stage(_nodes(spark, d), "nodes")
    checked = E.proof_faults(found, _PATH, nodes, "Entity", "Policy", 2, 3).unionByName(E.proof_faults(short, _PATH, nodes, "Entity", "Policy", 2, 3)).unionByName(E.proof_faults(found, _PATH, nodes, "Entity", "Claim", 2, 3))
    return checked.groupBy("fault").agg(F.count(F.lit(1)).alias("paths"))


def write_query_ids(spark, d):
    """The id of each claim's write, which repeating it doesn't change."""
    c = table(spark, d, "claim").select("claim_id", "predicate").distinct()
    return c.select("claim_id", "predicate", E.query_id("MERGE claim", {"id": F.col("claim_id"), "predicate": F.col("predicate")}).alias("query_id"))


QUERIES = {f.__name__: f for f in (evidence_nodes, evidence_edges, evidence_faults, observation_evidence, conflict_reads, identity_reads, resolved_sources, source_claims, entity_presence, version_relations, policy_paths, requested_paths, path_sequences, path_proofs, write_query_ids)}

_X = """WITH x AS (SELECT DISTINCT concat_ws('|', 'conflict', claim_id, compared_claim_id) AS conflict, claim_id AS l, compared_claim_id AS r, lower(trim(comparison_resolution, ' ')) AS resolution, lower(trim(predicate, ' ')) AS predicate FROM claim WHERE compared_claim_id IS NOT NULL),
u0 AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY decided_at NULLS FIRST, status NULLS FIRST) AS k FROM (SELECT DISTINCT * FROM identity_decision WHERE decision_id IS NOT NULL)),
u AS (SELECT decision_id, list_sort(list_distinct(list_transform(candidate_source_object_ids, lambda i: lower(trim(i, ' '))))) AS ids, signals, constraints, decided_at AS dt FROM u0 WHERE k = 1),
s AS (SELECT * FROM (SELECT decision_id, lag(decision_id) OVER (PARTITION BY ids ORDER BY dt NULLS FIRST, decision_id) AS former FROM u WHERE len(ids) > 1) WHERE former IS NOT NULL),
pp AS (SELECT lower(trim(predicate, ' ')) AS predicate, lower(trim(source_system, ' ')) AS system, min(policy_id) AS policy FROM authority_policy GROUP BY ALL),
ws AS (SELECT claim_id AS w, min(lower(trim(source_system, ' '))) AS system FROM claim GROUP BY 1),
dd AS (SELECT DISTINCT conflict, policy FROM x JOIN ws ON w = CASE resolution WHEN 'left' THEN l WHEN 'right' THEN r END JOIN pp ON pp.predicate = x.predicate AND pp.system = ws.system),
n AS (SELECT DISTINCT * FROM (SELECT 'Claim' AS label, claim_id AS id FROM claim UNION ALL SELECT 'Entity', subject_entity_id FROM claim UNION ALL SELECT 'SourceObject', source_object_id FROM documents UNION ALL SELECT 'Policy', policy_id FROM authority_policy UNION ALL SELECT 'Conflict', conflict FROM x UNION ALL SELECT 'Observation', 'obs|' || claim_id FROM claim
  UNION ALL SELECT 'Decision', decision_id FROM u UNION ALL SELECT 'Identity', unnest(ids) FROM u UNION ALL SELECT 'Signal', unnest(signals) FROM u UNION ALL SELECT 'Constraint', unnest(constraints) FROM u) WHERE id IS NOT NULL),
e AS (SELECT DISTINCT * FROM (SELECT 'ASSERTS' AS type, subject_entity_id AS src, claim_id AS dst, NULL AS role FROM claim UNION ALL SELECT 'OBSERVED_AS', claim_id, 'obs|' || claim_id, NULL FROM claim UNION ALL SELECT 'OBSERVED_IN', 'obs|' || claim_id, source_object_id, NULL FROM claim UNION ALL SELECT 'SUPPORTED_BY', claim_id, source_object_id, NULL FROM claim
  UNION ALL SELECT 'RESOLVES_TO', source_object_id, subject_entity_id, NULL FROM claim UNION ALL SELECT 'CONSIDERS', conflict, l, 'left' FROM x UNION ALL SELECT 'CONSIDERS', conflict, r, 'right' FROM x UNION ALL SELECT 'DECIDED_BY', conflict, policy, NULL FROM dd UNION ALL SELECT 'CONSIDERS', decision_id, unnest(ids), NULL FROM u
  UNION ALL SELECT 'SUPPORTED_BY', decision_id, unnest(signals), NULL FROM u UNION ALL SELECT 'BLOCKED_BY', decision_id, unnest(constraints), NULL FROM u UNION ALL SELECT 'SUPERSEDES', decision_id, former, NULL FROM s) WHERE src IS NOT NULL AND dst IS NOT NULL),
ab AS (SELECT DISTINCT subject_entity_id AS a, claim_id AS b, conflict AS c, policy AS p FROM claim JOIN (SELECT conflict, l AS k FROM x UNION SELECT conflict, r FROM x) y ON y.k = claim_id JOIN dd USING (conflict) WHERE subject_entity_id IS NOT NULL)
"""
_LIST = "coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE e.src = u.decision_id AND type = '{t}' AND role IS NULL), '') AS {n}"
SQL = {
    "evidence_nodes": _X + "SELECT * FROM n",
    "evidence_edges": _X + "SELECT * FROM e",
    "evidence_faults": _X + ", n2 AS (SELECT * FROM n UNION SELECT 'Question', question_id FROM conflict_case WHERE question_id IS NOT NULL) SELECT type, CASE WHEN a AND b THEN 'both_missing' WHEN a THEN 'source_missing' ELSE 'target_missing' END AS fault, count(*) AS edges FROM (SELECT type, src NOT IN (SELECT id FROM n2) AS a, dst NOT IN (SELECT id FROM n2) AS b FROM (SELECT type, src, dst FROM e UNION ALL SELECT DISTINCT 'RETRIEVED', question_id, source_object_id FROM retrieval_candidate JOIN documents USING (doc_id) WHERE question_id IS NOT NULL AND source_object_id IS NOT NULL)) WHERE a OR b GROUP BY ALL UNION ALL SELECT 'node', 'two_labels', count(*) FROM (SELECT id FROM n2 GROUP BY id HAVING count(DISTINCT label) > 1) HAVING count(*) > 0",
    "observation_evidence": "SELECT DISTINCT a.subject_entity_id AS entity, a.claim_id AS claim, 'obs|' || a.claim_id AS observation, b.source_object_id AS source FROM claim a JOIN claim b USING (claim_id) WHERE a.subject_entity_id IS NOT NULL AND b.source_object_id IS NOT NULL",
    "conflict_reads": _X + "SELECT conflict, any_value(l) AS left_claim, any_value(r) AS right_claim, min(policy) AS policy, min(resolution) AS resolution, CASE min(resolution) WHEN 'left' THEN any_value(l) WHEN 'right' THEN any_value(r) END AS winner, CASE WHEN any_value(l) = any_value(r) THEN 'same_claim' WHEN min(resolution) IN ('left', 'right') AND min(policy) IS NULL THEN 'undecided' WHEN coalesce(min(resolution) NOT IN ('left', 'right'), true) AND min(policy) IS NOT NULL THEN 'needless_policy' END AS fault FROM x LEFT JOIN dd USING (conflict) GROUP BY conflict",
    "identity_reads": _X + "SELECT decision_id AS decision, " + ", ".join(_LIST.format(t=t, n=n) for t, n in (("CONSIDERS", "considers"), ("SUPPORTED_BY", "supported_by"), ("BLOCKED_BY", "blocked_by"), ("SUPERSEDES", "supersedes"))) + " FROM u WHERE decision_id IN (SELECT src FROM e WHERE role IS NULL AND type IN ('CONSIDERS', 'SUPPORTED_BY', 'BLOCKED_BY', 'SUPERSEDES'))",
    "resolved_sources": "WITH r AS (SELECT source_object_id, count(DISTINCT subject_entity_id) AS n, min(subject_entity_id) AS m FROM claim GROUP BY 1), j AS (SELECT d.source_object_id, coalesce(n, 0) AS n, m FROM (SELECT DISTINCT source_object_id FROM documents WHERE source_object_id IS NOT NULL) d LEFT JOIN r USING (source_object_id)) SELECT CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS fault, count(*) AS sources, count(DISTINCT CASE WHEN n = 1 THEN m END) AS entities FROM j GROUP BY 1",
    "source_claims": "SELECT DISTINCT a.source_object_id, b.predicate, a.claim_id FROM claim a JOIN claim b USING (claim_id) WHERE a.source_object_id IN (SELECT unnest(source_object_ids) FROM source_version_group)",
    "entity_presence": "SELECT DISTINCT compared_claim_id AS id, compared_claim_id IN (SELECT claim_id FROM claim WHERE claim_id IS NOT NULL) AS present FROM claim WHERE compared_claim_id IS NOT NULL",
    "version_relations": """SELECT l.source_object_id AS "left", r.source_object_id AS "right", CASE WHEN l.payload_digest IS NOT DISTINCT FROM r.payload_digest THEN 'same_payload' WHEN l.observed_at IS NULL OR r.observed_at IS NULL OR l.observed_at = r.observed_at THEN 'unordered' WHEN l.observed_at < r.observed_at THEN 'precedes' ELSE 'follows' END AS relation
      FROM documents l JOIN documents r USING (source_type, source_native_id) WHERE l.source_object_id < r.source_object_id""",
    "policy_paths": _X + "SELECT a AS start, p AS \"end\", 3 AS hops, concat_ws('>', a, b, c, p) AS nodes, 'ASSERTS>CONSIDERED_BY>DECIDED_BY' AS types, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY a, p ORDER BY b, c) AS place FROM ab) WHERE place <= 2",
    "requested_paths": _X + ", f AS (SELECT a, p, min(concat_ws('>', a, b, c, p)) AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY a, p ORDER BY b, c) AS k FROM ab) WHERE k = 1 GROUP BY ALL), q AS (SELECT a AS s, p AS t FROM f UNION SELECT subject_entity_id, (SELECT min(policy_id) FROM authority_policy) FROM claim WHERE subject_entity_id IS NOT NULL) SELECT s AS start, t AS \"end\", CASE WHEN nodes IS NULL THEN 0 ELSE 3 END AS hops, nodes FROM q LEFT JOIN f ON a = s AND p = t",
    "path_sequences": "SELECT claim_id AS start, CASE WHEN n = 1 THEN concat_ws('>', claim_id, 'obs|' || claim_id, m) END AS nodes, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS fault FROM (SELECT claim_id, count(DISTINCT source_object_id) AS n, min(source_object_id) AS m FROM claim WHERE claim_id IS NOT NULL GROUP BY 1)",
    "path_proofs": _X + ", f AS (SELECT DISTINCT a, p FROM ab), g AS (SELECT DISTINCT subject_entity_id, claim_id FROM claim WHERE subject_entity_id IS NOT NULL AND claim_id IS NOT NULL) SELECT NULL AS fault, count(*) AS paths FROM f UNION ALL SELECT 'length', count(*) FROM g UNION ALL SELECT 'labels', count(*) FROM f",
    "write_query_ids": """SELECT DISTINCT claim_id, predicate, 'query_' || substr(sha256('query' || chr(0) || '{"id":' || CASE WHEN claim_id IS NULL THEN 'null' ELSE CAST(to_json(claim_id) AS VARCHAR) END || ',"predicate":' || CASE WHEN predicate IS NULL THEN 'null' ELSE CAST(to_json(predicate) AS VARCHAR) END || ',"query":"MERGE claim"}'), 1, 24) AS query_id FROM claim""",
}
