"""Claims: extraction, consolidation, conflicts, adjudication and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import slug
from tessella.operators import claims as C
from tessella.plans import table
from tessella.staging import stage

_TIME = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def _claims(spark, d):
    """The claim table in the form of the operators, each claim once."""
    t = F.trim("observed_at")
    observed = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(_TIME), t).try_cast("timestamp")
    return table(spark, d, "claim").select(
        F.col("claim_id").alias("observation"), F.col("subject_entity_id").alias("subject"), slug(F.col("predicate")).alias("predicate"), F.trim("object_value").alias("value"), F.lower(F.trim("datatype")).alias("datatype"), F.col("source_object_id").alias("source"),
        F.lower(F.trim("source_system")).alias("system"), "extractor_version", "valid_from", "valid_to", observed.alias("observed"),
    ).where("subject IS NOT NULL AND value <> ''").distinct()


def _trust(spark, d):
    return table(spark, d, "authority_policy").groupBy(slug(F.col("predicate")).alias("predicate"), F.lower(F.trim("source_system")).alias("system")).agg(F.max("priority").alias("priority"))


def structural_claims(spark, d):
    e = table(spark, d, "herb_employee").distinct()
    c = table(spark, d, "herb_customer").distinct()
    own = C.extract(e.withColumn("source", F.lit("employees")), "employee_id", "source", {"display_name": F.col("name"), "role": F.col("role"), "location": F.col("location"), "member_of": F.col("org")})
    theirs = C.extract(c.withColumn("source", F.lit("customers")), "id", "source", {"display_name": F.col("name"), "role": F.col("role"), "works_at": F.col("company")})
    return own.unionByName(theirs)


def extraction_gaps(spark, d):
    known = table(spark, d, "org_reference").select(F.col("company").alias("name"), "org_id").where("name IS NOT NULL")
    found, gaps = C.referenced(structural_claims(spark, d), "works_at", known, "org_id")
    return found.select("subject", "object").unionByName(gaps.select("subject", F.lit(None).cast("string").alias("object")))


def _typed(spark, d):
    """Employees, customers, documents and organisations as typed objects; employees without a location are no entity, and groups of versions have no rules."""
    e, c = table(spark, d, "herb_employee").distinct(), table(spark, d, "herb_customer").distinct()
    docs, groups = table(spark, d, "documents"), table(spark, d, "source_version_group").select("group_id").distinct()
    source = lambda kind, x: F.concat(F.lit(kind + "|"), F.col(x).cast("string"))
    one = lambda df, kind, x: df.where(F.col(x).isNotNull()).select(source(kind, x).alias("source"), F.lit(kind).alias("type")).distinct()
    objects = one(e, "employee", "employee_id").unionByName(one(c, "customer", "id")).unionByName(one(docs, "document", "doc_id")).unionByName(one(e, "product", "org")).unionByName(one(groups, "version_group", "group_id"))
    fields = lambda df, kind, x, names: df.where(F.col(x).isNotNull()).select(source(kind, x).alias("source"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(v).cast("string").alias("value")) for f, v in names.items()))).alias("v")).select("source", "v.*")
    attributes = fields(e, "employee", "employee_id", {"name": "name", "role": "role", "location": "location", "organization": "org"}).unionByName(fields(c, "customer", "id", {"name": "name", "role": "role", "company": "company"})).unionByName(fields(docs, "document", "doc_id", {"title": "title", "system": "source_type", "dataset": "source", "digest": "payload_digest"})).unionByName(fields(e, "product", "org", {"name": "org"}))
    links = e.where("org IS NOT NULL").select(source("product", "org").alias("source"), F.lit("team").alias("field"), F.col("employee_id").alias("external")).distinct()
    people = e.where("location IS NOT NULL AND employee_id IS NOT NULL").select("employee_id").distinct()
    others = objects.where("type <> 'employee'").select("source", F.concat(F.lit("entity|"), "source").alias("entity"))
    by_source = people.select(source("employee", "employee_id").alias("source"), F.concat(F.lit("entity|"), source("employee", "employee_id")).alias("entity")).unionByName(others)
    by_external = people.select(F.lit("person").alias("namespace"), F.col("employee_id").alias("external"), F.concat(F.lit("entity|"), source("employee", "employee_id")).alias("entity"))
    return C.typed_claims(objects, attributes, links, by_source, by_external)


def typed_claims(spark, d):
    return _typed(spark, d)[0]


def named_organisations(spark, d):
    return _typed(spark, d)[1]


def typed_gaps(spark, d):
    return _typed(spark, d)[2]


def claim_consolidation(spark, d):
    return C.consolidate(_claims(spark, d)).select("subject", "predicate", "value", "source", "first_observation", "observations")


def corroborated_statements(spark, d):
    return C.corroborations(C.consolidate(_claims(spark, d))).select("subject", "predicate", "value", "sources")


def answer_groups(spark, d):
    return C.answer_groups(_claims(spark, d).withColumnRenamed("observation", "claim"))


def latest_observations(spark, d):
    """Of each subject and predicate the claim of the newest extractor, then observed last."""
    from tessella.functions.text import version_rank
    from tessella.operators.intake import once

    order = [version_rank(F.col("extractor_version")).desc(), F.col("observed").desc_nulls_last(), F.col("observation").asc()]
    return once(_claims(spark, d), ["subject", "predicate"], order).select("subject", "predicate", "observation", "value")


def _conflicts(spark, d):
    return C.conflicts(_claims(spark, d).withColumnRenamed("observation", "claim"), ["subject", "predicate"])


def conflict_discovery(spark, d):
    """Conflicts of all claims."""
    return _conflicts(spark, d).select("subject", "predicate", "l_claim", "r_claim", "relation")


def conflict_adjudication(spark, d):
    return C.adjudicate(_conflicts(spark, d), _trust(spark, d)).select("subject", "predicate", "l_claim", "r_claim", "relation", "winner", "decided_by")


def tiered_adjudication(spark, d):
    """The same with a lifecycle tier, by extraction method (manual over structural over llm), and a recency policy for two predicates."""
    methods = spark.createDataFrame([("llm", 0), ("structural", 1), ("manual", 2)], "lifecycle string, rank int")
    predicates = _trust(spark, d).select("predicate").distinct()
    recent = predicates.where(F.col("predicate").isin("approver", "region"))
    own = lambda x: table(spark, d, "claim").groupBy(F.col("claim_id").alias(f"{x}_claim")).agg(F.min("extraction_method").alias(f"{x}_lifecycle"))
    pairs = _conflicts(spark, d).join(own("l"), "l_claim").join(own("r"), "r_claim")
    found = C.adjudicate(pairs, _trust(spark, d), predicates.crossJoin(F.broadcast(methods)), recent)
    return found.groupBy("predicate", "winner", "decided_by").agg(F.count(F.lit(1)).alias("pairs"))


def _logged(spark, d):
    """Logged comparisons with both claims' columns."""
    c = table(spark, d, "claim").where("compared_claim_id IS NOT NULL").select("claim_id", "compared_claim_id", F.lower(F.trim("comparison_resolution")).alias("resolution")).distinct()
    fields = ["subject", "predicate", "value", "datatype", "source", "system", "observed", "valid_from", "valid_to"]
    side = lambda x: _claims(spark, d).select(F.col("observation").alias(f"{x}_claim"), *(F.col(f).alias(f"{x}_{f}") for f in fields))
    return c.withColumnRenamed("claim_id", "l_claim").withColumnRenamed("compared_claim_id", "r_claim").join(side("l"), "l_claim").join(side("r"), "r_claim")


def logged_comparisons(spark, d):
    """Comparisons as the table has them against those of authority and recency."""
    pairs = _logged(spark, d).withColumn("predicate", F.col("l_predicate"))
    return C.adjudicate(pairs, _trust(spark, d)).groupBy("resolution", "winner", "decided_by").agg(F.count(F.lit(1)).alias("comparisons"))


def compared_relations(spark, d):
    """What logged pairs are to each other; of two subjects or predicates, incomparable."""
    aligned = (F.col("l_subject") == F.col("r_subject")) & (F.col("l_predicate") == F.col("r_predicate"))
    return _logged(spark, d).groupBy("resolution", C.relation(aligned=aligned).alias("relation")).agg(F.count(F.lit(1)).alias("comparisons"))


def _groups(spark, d):
    """For each subject known to an entity table and each predicate: what ``verdicts`` asks."""
    c = _claims(spark, d)
    claims = c.groupBy("subject", "predicate").agg(F.count_distinct("observation").alias("claims"))
    decided = stage(C.adjudicate(_conflicts(spark, d), _trust(spark, d)).where("relation = 'contradiction'").select("subject", "predicate", "l_claim", "r_claim", "winner"), "decided")
    opened = decided.where("winner = 'unresolved'").groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("open_conflicts"))
    lost = C.losers(decided, ["subject", "predicate"]).groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("lost"))
    asked = c.select("subject").distinct().crossJoin(F.broadcast(_trust(spark, d).select("predicate").distinct()))
    known = c.groupBy("subject").agg(F.max(F.col("system").isin("jira", "confluence", "github")).alias("identified"), F.max("observed").isNotNull().alias("covered"))
    return asked.join(claims, ["subject", "predicate"], "left").join(opened, ["subject", "predicate"], "left").join(lost, ["subject", "predicate"], "left").join(known, "subject")


def verdicts(spark, d):
    return C.verdicts(_groups(spark, d)).select("subject", "predicate", "verdict", "reason", "answers", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("open_conflicts", F.lit(0)).alias("open_conflicts"))


def ablation_matrix(spark, d):
    return C.ablations(_groups(spark, d))


def counterfactuals(spark, d):
    """What would have to change for each verdict to be another: the kind of change, and how many conflicts or claims it is about."""
    v = C.verdicts(_groups(spark, d))
    kind = F.when(F.col("reason") == "identity_missing", "resolve_identity").when(F.col("reason") == "claims_disputed", "resolve_conflict").when((F.col("reason") == "claim_supported") & (F.col("answers") == 1), "remove_only_claim").when(F.col("reason") == "claim_supported", "contradict_all_claims").when(F.col("reason") == "evidence_absent", "add_evidence").otherwise("complete_coverage")
    about = F.when(F.col("reason") == "claims_disputed", F.col("open_conflicts")).when(F.col("reason") == "claim_supported", F.col("answers")).otherwise(0)
    return v.groupBy("predicate", "verdict", kind.alias("change")).agg(F.count(F.lit(1)).alias("subjects"), F.sum(about).alias("about"))


QUERIES = {f.__name__: f for f in (structural_claims, extraction_gaps, typed_claims, named_organisations, typed_gaps, claim_consolidation, corroborated_statements, answer_groups, latest_observations, conflict_discovery, conflict_adjudication, tiered_adjudication, logged_comparisons, compared_relations, verdicts, ablation_matrix, counterfactuals)}

_SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(trim({x}, ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_COLLAPSE = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' '))"
_T = "trim(observed_at, ' ')"
_C = f"""WITH c AS (SELECT DISTINCT claim_id AS claim, subject_entity_id AS subject, {_SLUG.format(x="predicate")} AS predicate, trim(object_value, ' ') AS value, lower(trim(datatype, ' ')) AS datatype, source_object_id AS source, lower(trim(source_system, ' ')) AS system, extractor_version, valid_from, valid_to,
  CASE WHEN regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({_T} || 'T00:00:00Z' AS TIMESTAMPTZ) WHEN regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN try_cast({_T} AS TIMESTAMPTZ) END AS observed
  FROM claim WHERE subject_entity_id IS NOT NULL AND trim(object_value, ' ') <> ''),
t AS (SELECT {_SLUG.format(x="predicate")} AS predicate, lower(trim(source_system, ' ')) AS system, max(priority) AS priority FROM authority_policy GROUP BY ALL),
p AS (SELECT l.subject, l.predicate, l.claim AS l_claim, r.claim AS r_claim, l.system AS l_system, r.system AS r_system, l.observed AS l_observed, r.observed AS r_observed,
  CASE WHEN coalesce(l.valid_to <= r.valid_from, false) OR coalesce(r.valid_to <= l.valid_from, false) THEN 'supersession' ELSE 'contradiction' END AS relation
  FROM c l JOIN c r ON l.subject = r.subject AND l.predicate = r.predicate AND l.claim < r.claim AND l.system <> r.system AND NOT coalesce(l.source = r.source, false) AND (l.value IS DISTINCT FROM r.value OR l.datatype IS DISTINCT FROM r.datatype)),
"""
_A = """{name} AS (SELECT {src}.*, CASE WHEN a.priority > b.priority THEN 'left' WHEN b.priority > a.priority THEN 'right' WHEN a.priority = b.priority AND l_observed > r_observed THEN 'left' WHEN a.priority = b.priority AND r_observed > l_observed THEN 'right' ELSE 'unresolved' END AS winner,
  CASE WHEN a.priority IS NULL OR b.priority IS NULL THEN 'no_policy' WHEN a.priority <> b.priority THEN 'authority' WHEN l_observed <> r_observed THEN 'recency' ELSE 'no_decisive_rule' END AS decided_by
  FROM {src} LEFT JOIN t a ON a.predicate = {src}.predicate AND a.system = l_system LEFT JOIN t b ON b.predicate = {src}.predicate AND b.system = r_system)"""
_ADJ = _C + _A.format(name="z", src="p")
_TIERS = _C + """m(lifecycle, rank) AS (VALUES ('llm', 0), ('structural', 1), ('manual', 2)), e AS (SELECT claim_id, min(extraction_method) AS lifecycle FROM claim GROUP BY 1),
w AS (SELECT p.*, a.priority AS pa, b.priority AS pb, CASE WHEN p.predicate IN (SELECT predicate FROM t) THEN ma.rank END AS ra, CASE WHEN p.predicate IN (SELECT predicate FROM t) THEN mb.rank END AS rb, p.predicate IN ('approver', 'region') AND p.predicate IN (SELECT predicate FROM t) AS recent
  FROM p LEFT JOIN t a ON a.predicate = p.predicate AND a.system = l_system LEFT JOIN t b ON b.predicate = p.predicate AND b.system = r_system
  JOIN e ea ON ea.claim_id = l_claim JOIN e eb ON eb.claim_id = r_claim LEFT JOIN m ma ON ma.lifecycle = ea.lifecycle LEFT JOIN m mb ON mb.lifecycle = eb.lifecycle)
SELECT predicate, CASE WHEN pa > pb THEN 'left' WHEN pb > pa THEN 'right' WHEN ra > rb THEN 'left' WHEN rb > ra THEN 'right' WHEN recent AND l_observed > r_observed THEN 'left' WHEN recent AND r_observed > l_observed THEN 'right' ELSE 'unresolved' END AS winner,
  CASE WHEN pa <> pb THEN 'authority' WHEN ra <> rb THEN 'lifecycle' WHEN recent AND l_observed <> r_observed THEN 'recency' WHEN (pa IS NULL OR pb IS NULL) AND (ra IS NULL OR rb IS NULL) AND NOT recent THEN 'no_policy' ELSE 'no_decisive_rule' END AS decided_by, count(*) AS pairs FROM w GROUP BY ALL"""
_LOGGED = """m AS (SELECT DISTINCT claim_id AS l_claim, compared_claim_id AS r_claim, lower(trim(comparison_resolution, ' ')) AS resolution FROM claim WHERE compared_claim_id IS NOT NULL),
q AS (SELECT m.*, l.predicate, l.subject = r.subject AND l.predicate = r.predicate AS aligned, l.value IS NOT DISTINCT FROM r.value AND l.datatype IS NOT DISTINCT FROM r.datatype AS same, l.source IS NOT DISTINCT FROM r.source AS one, coalesce(l.valid_to <= r.valid_from, false) OR coalesce(r.valid_to <= l.valid_from, false) AS over_,
  l.system AS l_system, r.system AS r_system, l.observed AS l_observed, r.observed AS r_observed FROM m JOIN c l ON l.claim = l_claim JOIN c r ON r.claim = r_claim)"""
_GROUPS = _ADJ + """,
n AS (SELECT subject, predicate, count(DISTINCT claim) AS claims FROM c GROUP BY ALL),
x AS (SELECT subject, predicate, count(DISTINCT CASE winner WHEN 'left' THEN r_claim ELSE l_claim END) AS lost FROM z WHERE relation = 'contradiction' AND winner <> 'unresolved' GROUP BY ALL),
o AS (SELECT subject, predicate, count(*) AS open_conflicts FROM z WHERE relation = 'contradiction' AND winner = 'unresolved' GROUP BY ALL),
i AS (SELECT subject, bool_or(system IN ('jira', 'confluence', 'github')) AS identified, max(observed) IS NOT NULL AS covered FROM c GROUP BY ALL),
g AS (SELECT i.subject, q.predicate, coalesce(claims, 0) AS claims, coalesce(open_conflicts, 0) AS open_conflicts, coalesce(lost, 0) AS lost, identified, covered FROM i CROSS JOIN (SELECT DISTINCT predicate FROM t) q LEFT JOIN n USING (subject, predicate) LEFT JOIN o USING (subject, predicate) LEFT JOIN x USING (subject, predicate))
"""
_V = "CASE WHEN NOT {i} THEN 'UNKNOWN' WHEN {o} > 0 THEN 'DISPUTED' WHEN {n} > 0 THEN 'SUPPORTED' WHEN {c} THEN 'NOT_FOUND' ELSE 'UNKNOWN' END"
_PLAIN = _V.format(i="identified", o="open_conflicts", n="claims", c="covered")
_REASON = "CASE WHEN NOT identified THEN 'identity_missing' WHEN open_conflicts > 0 THEN 'claims_disputed' WHEN claims > 0 THEN 'claim_supported' WHEN covered THEN 'evidence_absent' ELSE 'coverage_incomplete' END"
_ANSWERS = f"CASE WHEN {_REASON} = 'claim_supported' THEN claims - lost ELSE 0 END"
_STRUCTURAL = """WITH e AS (SELECT DISTINCT * FROM herb_employee), u AS (SELECT DISTINCT * FROM herb_customer),
s AS (SELECT employee_id AS subject, 'display_name' AS predicate, name AS value, 'employees' AS source FROM e UNION ALL SELECT employee_id, 'role', role, 'employees' FROM e UNION ALL SELECT employee_id, 'location', location, 'employees' FROM e UNION ALL SELECT employee_id, 'member_of', org, 'employees' FROM e
  UNION ALL SELECT id, 'display_name', name, 'customers' FROM u UNION ALL SELECT id, 'role', role, 'customers' FROM u UNION ALL SELECT id, 'works_at', company, 'customers' FROM u),
f AS (SELECT * FROM s WHERE subject IS NOT NULL AND trim(value, ' ') <> '') """
_ABLATED = " UNION ALL ".join(
    f"SELECT '{name}' AS ablation, {_V.format(i=i, o=o, n=n, c=c)} AS verdict FROM g"
    for name, i, o, n, c in (("none", "identified", "open_conflicts", "claims", "covered"), ("no_identity", "false", "open_conflicts", "claims", "covered"), ("no_conflicts", "identified", "0", "claims", "covered"), ("no_claims", "identified", "0", "0", "covered"), ("no_coverage", "identified", "open_conflicts", "claims", "false"), ("no_claims_no_coverage", "identified", "0", "0", "false"))
)
_ORG = "'organization_' || substr(sha256('organization' || chr(0) || '{\"name\":' || CAST(to_json(" + _COLLAPSE.format(x="v") + ") AS VARCHAR) || '}'), 1, 24)"
_TYPED = f"""WITH e AS (SELECT DISTINCT * FROM herb_employee), u AS (SELECT DISTINCT * FROM herb_customer), k AS (SELECT DISTINCT employee_id FROM e WHERE location IS NOT NULL AND employee_id IS NOT NULL),
a AS (SELECT 'employee|' || employee_id AS source, 'display_name' AS predicate, 'literal' AS kind, name AS v FROM e UNION ALL SELECT 'employee|' || employee_id, 'has_role', 'literal', role FROM e UNION ALL SELECT 'employee|' || employee_id, 'located_in', 'literal', location FROM e UNION ALL SELECT 'employee|' || employee_id, 'member_of', 'entity', org FROM e
  UNION ALL SELECT 'customer|' || id, 'display_name', 'literal', name FROM u UNION ALL SELECT 'customer|' || id, 'has_role', 'literal', role FROM u UNION ALL SELECT 'customer|' || id, 'works_at', 'entity', company FROM u UNION ALL SELECT 'product|' || org, 'display_name', 'literal', org FROM e
  UNION ALL SELECT 'document|' || doc_id, 'document_title', 'literal', title FROM documents UNION ALL SELECT 'document|' || doc_id, 'origin_system', 'literal', source_type FROM documents UNION ALL SELECT 'document|' || doc_id, 'part_of_dataset', 'literal', source FROM documents UNION ALL SELECT 'document|' || doc_id, 'content_digest', 'literal', payload_digest FROM documents),
f AS (SELECT * FROM a WHERE source IS NOT NULL AND trim(v, ' ') <> '' AND (source NOT LIKE 'employee|%' OR source IN (SELECT 'employee|' || employee_id FROM k))),
t AS (SELECT DISTINCT 'product|' || org AS source, employee_id FROM e WHERE org IS NOT NULL AND employee_id IS NOT NULL) """
SQL = {
    "typed_claims": _TYPED + f"SELECT DISTINCT 'entity|' || source AS subject, predicate, kind, CASE kind WHEN 'entity' THEN {_ORG} ELSE v END AS value, source FROM f UNION ALL SELECT 'entity|' || source, 'has_team_member', 'entity', 'entity|employee|' || employee_id, source FROM t WHERE employee_id IN (SELECT employee_id FROM k)",
    "named_organisations": _TYPED + f"SELECT {_ORG} AS entity, min(v) AS name FROM f WHERE kind = 'entity' GROUP BY 1",
    "typed_gaps": _TYPED + "SELECT DISTINCT 'employee|' || employee_id AS source, '*' AS predicate, NULL AS external, 'subject_unresolved' AS reason FROM e WHERE employee_id NOT IN (SELECT employee_id FROM k) UNION ALL SELECT DISTINCT 'version_group|' || group_id, '*', NULL, 'unsupported_object_type' FROM source_version_group WHERE group_id IS NOT NULL UNION ALL SELECT source, 'has_team_member', employee_id, 'object_unresolved' FROM t WHERE employee_id NOT IN (SELECT employee_id FROM k)",
    "structural_claims": _STRUCTURAL + "SELECT * FROM f",
    "extraction_gaps": _STRUCTURAL + f", n AS (SELECT {_COLLAPSE.format(x='company')} AS n, min(org_id) AS object FROM org_reference WHERE company IS NOT NULL GROUP BY 1) SELECT subject, object FROM f LEFT JOIN n ON n = {_COLLAPSE.format(x='value')} WHERE predicate = 'works_at'",
    "claim_consolidation": _C.rstrip(",\n") + " SELECT subject, predicate, value, source, min(claim) AS first_observation, count(*) AS observations FROM c GROUP BY subject, predicate, value, source, valid_from, valid_to",
    "corroborated_statements": _C.rstrip(",\n") + " SELECT subject, predicate, value, count(DISTINCT source) AS sources FROM c GROUP BY subject, predicate, value, valid_from, valid_to HAVING count(DISTINCT source) > 1",
    "answer_groups": _C.rstrip(",\n") + f" SELECT subject, predicate, CASE WHEN coalesce(datatype, 'string') IN ('string', 'text') THEN 'string:' || {_COLLAPSE.format(x='value')} ELSE datatype || ':' || value END AS answer, min(value) AS label, count(DISTINCT claim) AS claims, count(DISTINCT source) AS sources FROM c GROUP BY 1, 2, 3",
    "latest_observations": _C.rstrip(",\n") + " SELECT subject, predicate, claim AS observation, value FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY coalesce(try_cast(regexp_extract(extractor_version, '([0-9]+)$', 1) AS INT), 0) DESC, observed DESC NULLS LAST, claim) AS k2 FROM c) WHERE k2 = 1",
    "conflict_discovery": _C.rstrip(",\n") + " SELECT subject, predicate, l_claim, r_claim, relation FROM p",
    "conflict_adjudication": _ADJ + " SELECT subject, predicate, l_claim, r_claim, relation, winner, decided_by FROM z",
    "tiered_adjudication": _TIERS,
    "logged_comparisons": _C + _LOGGED + ", " + _A.format(name="y", src="q") + " SELECT resolution, winner, decided_by, count(*) AS comparisons FROM y GROUP BY ALL",
    "compared_relations": _C + _LOGGED + " SELECT resolution, CASE WHEN NOT aligned THEN 'incomparable' WHEN same AND one THEN 'equivalent' WHEN same THEN 'corroboration' WHEN over_ THEN 'supersession' ELSE 'contradiction' END AS relation, count(*) AS comparisons FROM q GROUP BY ALL",
    "verdicts": _GROUPS + f"SELECT subject, predicate, {_PLAIN} AS verdict, {_REASON} AS reason, {_ANSWERS} AS answers, claims, open_conflicts FROM g",
    "ablation_matrix": _GROUPS + f"SELECT ablation, verdict, count(*) AS groups FROM ({_ABLATED}) GROUP BY ALL",
    "counterfactuals": _GROUPS + f", v AS (SELECT *, {_PLAIN} AS verdict, {_REASON} AS reason, {_ANSWERS} AS answers FROM g) SELECT predicate, verdict, CASE WHEN reason = 'identity_missing' THEN 'resolve_identity' WHEN reason = 'claims_disputed' THEN 'resolve_conflict' WHEN reason = 'claim_supported' AND answers = 1 THEN 'remove_only_claim' WHEN reason = 'claim_supported' THEN 'contradict_all_claims' WHEN reason = 'evidence_absent' THEN 'add_evidence' ELSE 'complete_coverage' END AS change, count(*) AS subjects, sum(CASE reason WHEN 'claims_disputed' THEN open_conflicts WHEN 'claim_supported' THEN answers ELSE 0 END)::BIGINT AS about FROM v GROUP BY ALL",
}
