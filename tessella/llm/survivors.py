"""Best representative of each duplicate group, by window ordering over completeness, trust and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing value, trimmed and in lower case.
NO_VALUE = (
    "", "-", "--", "?", "??", "(blank)", "(empty)", "(none)", "blank", "empty", "missing", "n.a.", "n/a", "n/d", "na", "nan", "nil", "no value", "none", "not applicable",
    "not available", "not known", "not set", "not specified", "null", "tba", "tbc", "tbd", "to be announced", "to be confirmed", "to be decided", "to be determined", "undefined", "unknown", "unset", "unspecified", "–", "—",
)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def is_real(x: Column) -> Column:
    """True where a value is neither null, blank nor a word that stands for none."""
    return x.isNotNull() & ~F.lower(trimmed(x)).isin(*NO_VALUE)


def instant(x: Column) -> Column:
    """A text as a timestamp: ISO with any offset and precision; without an offset UTC, a date alone midnight UTC; else null."""
    t = trimmed(x)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ][0-9:.,]+$"), F.concat(t, F.lit("Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), t)
    return full.try_cast("timestamp")


def best_of_group(df: DataFrame, group: list[str], best_first: list[Column]) -> DataFrame:
    """The first row of each group in the given order, whole.

    ``best_first`` must end in a key that tells rows apart, so the choice doesn't depend on partitions. Null
    groups are a group. Spark keeps one row a group and task before the shuffle, so a group with a third of
    all rows arrives as one row from each task.
    """
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*best_first))).where(F.col(rank) == 1).drop(rank)


def best_fields(df: DataFrame, group: list[str], fields: list[str], best_first: list[Column]) -> DataFrame:
    """One built record a group: each field from the best row in which that field has a real value.

    A field without any real value in the group is null. Aggregates are combined before the shuffle.
    """
    named = [c.alias(f"__o{i}") for i, c in enumerate(best_first)]
    keys = F.struct(*(f"__o{i}" for i in range(len(best_first))))
    real = lambda f: is_real(F.col(f)) if dict(df.dtypes)[f] == "string" else F.col(f).isNotNull()
    rows = df.select(*group, *fields, *named)
    return rows.groupBy(*group).agg(*(F.min_by(F.when(real(f), F.col(f)), F.when(real(f), keys)).alias(f) for f in fields))


def group_members(groups: DataFrame) -> DataFrame:
    """group_id, source_object_id of each member, once."""
    return groups.select("group_id", F.explode("source_object_ids").alias("source_object_id")).where("group_id IS NOT NULL AND source_object_id IS NOT NULL").distinct()


def _key(predicate: Column) -> Column:
    return F.regexp_replace(F.lower(predicate), "[^a-z0-9]", "")


def ranked_claims(claims: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims with a real value that members make: group_id, predicate as the policies spell it, claim_id, priority, observed.

    Predicates match by their letters and digits; one that no policy has keeps its own, trimmed, spelling.
    A system's priority for a predicate is its highest; a missing one is null.
    """
    system = F.lower(F.trim("source_system"))
    named = policies.where("predicate IS NOT NULL").groupBy(_key(F.col("predicate")).alias("key")).agg(F.min("predicate").alias("spelled"))
    trust = policies.groupBy(_key(F.col("predicate")).alias("key"), system.alias("system")).agg(F.max(F.when(~F.isnan("priority"), F.col("priority"))).alias("priority"))
    said = claims.where(is_real(F.col("object_value")) & F.col("claim_id").isNotNull() & F.col("predicate").isNotNull()).select("claim_id", "source_object_id", trimmed(F.col("predicate")).alias("own"), _key(F.col("predicate")).alias("key"), system.alias("system"), instant(F.col("observed_at")).alias("observed"))
    made = members.join(said, "source_object_id")
    return made.join(named, "key", "left").join(trust, ["key", "system"], "left").select("group_id", F.coalesce("spelled", "own").alias("predicate"), "claim_id", "priority", "observed")


def p7_found(spark, d: str) -> DataFrame:
    """The claim to keep of each group and predicate: group_id, predicate, claim_id."""
    groups, claims, policies = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("source_version_group", "claim", "authority_policy"))
    every = ranked_claims(claims, group_members(groups), policies)
    order = [F.col("priority").desc_nulls_last(), F.col("observed").desc_nulls_last(), F.col("claim_id").asc()]
    return best_of_group(every, ["group_id", "predicate"], order).select("group_id", "predicate", "claim_id")


def p7_records(spark, d: str) -> DataFrame:
    """One built document a version group, field by field: group_id, title, lang, source, n_chars."""
    groups, documents = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("source_version_group", "documents"))
    fields = ["title", "lang", "source", "n_chars"]
    versions = group_members(groups).join(documents.select("source_object_id", "observed_at", *fields), "source_object_id")
    missing = sum((~is_real(F.col(f))).cast("int") for f in fields[:3])
    newest = -F.coalesce(F.unix_micros("observed_at"), F.lit(-(1 << 62)))
    return best_fields(versions, ["group_id"], fields, [missing, newest, F.col("source_object_id")])


QUERIES = {"p7_found": p7_found, "p7_records": p7_records}

_WORDS = ", ".join("'" + w + "'" for w in NO_VALUE)
_TRIM = r"regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
_REAL = "({x} IS NOT NULL AND lower(" + _TRIM + ") NOT IN (" + _WORDS + "))"
_KEY = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_T = _TRIM.format(x="observed_at")
_MEMBERS = "members AS (SELECT DISTINCT group_id, source_object_id FROM (SELECT group_id, unnest(source_object_ids) AS source_object_id FROM source_version_group) WHERE group_id IS NOT NULL AND source_object_id IS NOT NULL)"
SQL = {
    "p7_found": f"""
WITH {_MEMBERS},
named AS (SELECT {_KEY.format(x="predicate")} AS key, min(predicate) AS spelled FROM authority_policy WHERE predicate IS NOT NULL GROUP BY 1),
trust AS (SELECT {_KEY.format(x="predicate")} AS key, lower(trim(source_system, ' ')) AS system, max(CASE WHEN NOT isnan(priority) THEN priority END) AS priority FROM authority_policy GROUP BY 1, 2),
said AS (
  SELECT claim_id, source_object_id, {_TRIM.format(x="predicate")} AS own, {_KEY.format(x="predicate")} AS key, lower(trim(source_system, ' ')) AS system,
         CASE WHEN regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({_T} || 'T00:00:00Z' AS TIMESTAMPTZ)
              WHEN regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.,]+$') THEN try_cast({_T} || 'Z' AS TIMESTAMPTZ)
              WHEN regexp_matches({_T}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') THEN try_cast({_T} AS TIMESTAMPTZ) END AS observed
  FROM claim WHERE claim_id IS NOT NULL AND predicate IS NOT NULL AND {_REAL.format(x="object_value")}),
ranked AS (
  SELECT group_id, coalesce(spelled, own) AS predicate, claim_id,
         row_number() OVER (PARTITION BY group_id, coalesce(spelled, own) ORDER BY priority DESC NULLS LAST, observed DESC NULLS LAST, claim_id) AS k
  FROM members JOIN said USING (source_object_id) LEFT JOIN named USING (key) LEFT JOIN trust USING (key, system))
SELECT group_id, predicate, claim_id FROM ranked WHERE k = 1
""",
    "p7_records": f"""
WITH {_MEMBERS},
versions AS (
  SELECT group_id, source_object_id, observed_at, title, lang, source, n_chars,
         {" + ".join(f"(NOT {_REAL.format(x=f)})::INT" for f in ("title", "lang", "source"))} AS missing
  FROM members JOIN documents USING (source_object_id))
SELECT group_id, {", ".join(f"first({f} ORDER BY missing, observed_at DESC NULLS LAST, source_object_id) FILTER (WHERE {r}) AS {f}" for f, r in [*((f, _REAL.format(x=f)) for f in ("title", "lang", "source")), ("n_chars", "n_chars IS NOT NULL")])}
FROM versions GROUP BY group_id
""",
}
