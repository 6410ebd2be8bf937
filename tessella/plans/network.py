"""The graph of customers, orders and parts, and of claims and their sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import evidence, graph
from tessella.plans import table

_ENDS = {"IN_REGION": ("nation", "n_nationkey", "region", "n_regionkey"), "IN_NATION": ("customer", "c_custkey", "nation", "c_nationkey"), "PLACED_BY": ("orders", "o_orderkey", "customer", "o_custkey"), "BASED_IN": ("supplier", "s_suppkey", "nation", "s_nationkey")}


def _nodes(spark, d):
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
    return graph.union([graph.nodes_of(table(spark, d, t), t, k) for t, k in keys.items()])


def _edges(spark, d):
    own = [graph.edges_of(table(spark, d, a), kind, (a, x), (b, y)) for kind, (a, x, b, y) in _ENDS.items()]
    lines = table(spark, d, "lineitem")
    return graph.union([*own, graph.edges_of(lines, "CONTAINS", ("orders", "l_orderkey"), ("part", "l_partkey")), graph.edges_of(lines, "SUPPLIED_BY", ("part", "l_partkey"), ("supplier", "l_suppkey"))])


def graph_nodes(spark, d):
    return _nodes(spark, d)


def graph_edges(spark, d):
    return _edges(spark, d).withColumn("edge", graph.edge_id())


def graph_fingerprint(spark, d):
    return graph.fingerprint(_edges(spark, d), ["type", "src", "dst"])


def dangling_edges(spark, d):
    return graph.dangling(_nodes(spark, d), _edges(spark, d))


def path_exact(spark, d):
    """Regions of the orders' customers, along exactly three edges."""
    start = _nodes(spark, d).where("label = 'orders'")
    return graph.follow(start, _edges(spark, d), ["PLACED_BY", "IN_NATION", "IN_REGION"]).select("start", "end")


def path_bounded(spark, d):
    """What every supplier and customer reaches within three hops."""
    start = _nodes(spark, d).where("label IN ('supplier', 'customer')")
    return graph.distances(start, _edges(spark, d), ["IN_NATION", "BASED_IN", "IN_REGION"], 3)


def exclusive_edges(spark, d):
    """Claims' decisions in two waves, of which the second replaces the first."""
    c = table(spark, d, "claim").where("compared_claim_id IS NOT NULL")
    wave = lambda to: c.select(F.lit("DECIDED_BY").alias("type"), F.col("claim_id").alias("src"), to.alias("dst")).where("dst IS NOT NULL").distinct()
    first, second = wave(F.col("compared_claim_id")), wave(F.when(F.lower("comparison_resolution") == "left", F.col("claim_id")))
    return graph.upsert_exclusive(first, second, "DECIDED_BY")


def merged_nodes(spark, d):
    """Nodes written twice with another property: the last write holds."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    waves = o.withColumn("wave", F.lit(1)).unionByName(o.where("id % 3 = 0").select("id", F.lit("X").alias("status")).withColumn("wave", F.lit(2)))
    return graph.merge_latest(waves, ["id"], "wave").groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def claim_evidence(spark, d):
    """Claims with the documents that they rest on and those documents' groups of versions."""
    c, docs = table(spark, d, "claim").select("claim_id", "predicate", "source_object_id").distinct(), table(spark, d, "documents").select("source_object_id", "doc_id", "source_type")
    groups = table(spark, d, "source_version_group").select("group_id", F.explode("source_object_ids").alias("source_object_id")).distinct()
    return c.join(docs, "source_object_id").join(groups, "source_object_id", "left").select("claim_id", "doc_id", "source_type", "group_id")


def team_members(spark, d):
    """Employees of each organisation, each once, along organisation, member and name claim; of several names the first claim's."""
    e = table(spark, d, "herb_employee").where("org IS NOT NULL AND employee_id IS NOT NULL")
    named = F.concat_ws("|", F.lit("name"), "employee_id", "name")
    edges = evidence.edge(e, "HAS_TEAM_MEMBER", "org", "employee_id").unionByName(evidence.edge(e.where("name IS NOT NULL"), "ASSERTS", "employee_id", named))
    members = edges.where("type = 'HAS_TEAM_MEMBER'").select(F.col("src").alias("org"), F.col("dst").alias("employee_id"))
    claims = e.where("name IS NOT NULL").select(named.alias("claim"), F.col("name").alias("display_name")).distinct()
    first = edges.where("type = 'ASSERTS'").groupBy(F.col("src").alias("employee_id")).agg(F.min("dst").alias("claim")).join(claims, "claim")
    return members.join(first, "employee_id", "left").select("org", "employee_id", "display_name")


def first_orders(spark, d):
    """Of each nation the customer that ordered first."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("k", k).where("k = 1").select("c_nationkey", "c_custkey", "o_orderkey")


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, graph_fingerprint, dangling_edges, path_exact, path_bounded, exclusive_edges, merged_nodes, claim_evidence, team_members, first_orders)}

_N = "SELECT 'region' AS label, 'region:' || r_regionkey AS id FROM region UNION SELECT 'nation', 'nation:' || n_nationkey FROM nation UNION SELECT 'customer', 'customer:' || c_custkey FROM customer UNION SELECT 'supplier', 'supplier:' || s_suppkey FROM supplier UNION SELECT 'orders', 'orders:' || o_orderkey FROM orders UNION SELECT 'part', 'part:' || p_partkey FROM part"
_E = " UNION ".join(f"SELECT '{kind}' AS type, '{a}:' || {x} AS src, '{b}:' || {y} AS dst FROM {a} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for kind, (a, x, b, y) in _ENDS.items()) + " UNION SELECT 'CONTAINS', 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION SELECT 'SUPPLIED_BY', 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem"
_PART = "CAST(sum(CAST('0x' || substr(h, {s}, 8) AS BIGINT)) AS HUGEINT)::VARCHAR"
SQL = {
    "graph_nodes": _N,
    "graph_edges": f"""SELECT *, 'edge_' || substr(sha256('edge' || chr(0) || '{{"dst":"' || dst || '","src":"' || src || '","type":"' || type || '"}}'), 1, 24) AS edge FROM ({_E})""",
    "graph_fingerprint": f"WITH h AS (SELECT md5(type || chr(31) || src || chr(31) || dst) AS h FROM ({_E})) SELECT count(*) AS rows, sha256({' || chr(45) || '.join(_PART.format(s=8 * i + 1) for i in range(3))}) AS digest FROM h",
    "dangling_edges": f"WITH n AS ({_N}), e AS ({_E}) SELECT DISTINCT * FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)",
    "path_exact": "SELECT 'orders:' || o_orderkey AS start, 'region:' || n_regionkey AS \"end\" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "path_bounded": f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_E}) WHERE type IN ('IN_NATION', 'BASED_IN', 'IN_REGION')),
      w AS (SELECT id AS start, id AS "end", 0 AS hops FROM ({_N}) WHERE label IN ('supplier', 'customer') UNION SELECT w.start, e.dst, hops + 1 FROM w JOIN e ON w."end" = e.src WHERE hops < 3)
      SELECT start, "end", min(hops) AS hops FROM w GROUP BY ALL""",
    "exclusive_edges": """WITH c AS (SELECT DISTINCT claim_id, compared_claim_id, lower(comparison_resolution) = 'left' AS own FROM claim WHERE compared_claim_id IS NOT NULL)
      SELECT DISTINCT 'DECIDED_BY' AS type, claim_id AS src, claim_id AS dst FROM c WHERE own UNION SELECT DISTINCT 'DECIDED_BY', claim_id, compared_claim_id FROM c WHERE claim_id NOT IN (SELECT claim_id FROM c WHERE own)""",
    "merged_nodes": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS orders FROM orders GROUP BY 1",
    "claim_evidence": "WITH g AS (SELECT DISTINCT group_id, unnest(source_object_ids) AS source_object_id FROM source_version_group) SELECT claim_id, doc_id, source_type, group_id FROM (SELECT DISTINCT claim_id, predicate, source_object_id FROM claim) JOIN documents USING (source_object_id) LEFT JOIN g USING (source_object_id)",
    "team_members": "WITH n AS (SELECT employee_id, min(name) AS display_name FROM herb_employee WHERE org IS NOT NULL AND employee_id IS NOT NULL GROUP BY 1) SELECT DISTINCT org, employee_id, display_name FROM herb_employee JOIN n USING (employee_id) WHERE org IS NOT NULL",
    "first_orders": "SELECT c_nationkey, c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k = 1",
}
