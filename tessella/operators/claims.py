"""Claims: extraction from records, consolidation, grouping, comparison and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import canonical_json, stable_id
from tessella.functions.text import collapsed, nfkc

KEYS = ("subject", "predicate", "value", "valid_from", "valid_to")


def extract(records: DataFrame, subject: str, source: str, predicates: dict[str, Column]) -> DataFrame:
    """subject, predicate, value, source of every attribute that has a value: one pass, a row an attribute."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("value")) for p, v in predicates.items()))).alias("c")
    made = records.select(F.col(subject).alias("subject"), F.col(source).alias("source"), each).select("subject", "c.*", "source")
    return made.where(F.col("subject").isNotNull() & (F.trim("value") != ""))


def referenced(claims: DataFrame, predicate: str, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Claims of a predicate whose value is known, with what it is known as; and those that are gaps."""
    own = claims.where(F.col("predicate") == predicate)
    names = known.select(collapsed(F.col("name")).alias("n"), F.col(key).alias("object")).groupBy("n").agg(F.min("object").alias("object"))
    joined = own.withColumn("n", collapsed(F.col("value"))).join(names, "n", "left").drop("n")
    return joined.where("object IS NOT NULL"), joined.where("object IS NULL").drop("object")


#: The predicate of each attribute of an object type that is a literal, and that names an organisation.
LITERALS = {
    ("employee", "name"): "display_name", ("employee", "role"): "has_role", ("employee", "location"): "located_in", ("customer", "name"): "display_name", ("customer", "role"): "has_role", ("product", "name"): "display_name", ("message_author", "name"): "display_name", ("message_author", "messages"): "message_count", ("team_structure", "name"): "display_name",
    ("document", "title"): "document_title", ("document", "system"): "origin_system", ("document", "dataset"): "part_of_dataset", ("document", "digest"): "content_digest",
}
ORGANISATIONS = {("employee", "organization"): "member_of", ("customer", "company"): "works_at"}
#: The predicate and the namespace of the external ids of each list of an object type.
LINKS = {("product", "team"): ("has_team_member", "person"), ("product", "customers"): ("serves_customer", "customer"), ("message_author", "product"): ("authored_messages_in_product", "product"), ("team_structure", "reports"): ("manages", "person")}
TYPES = ("document", "employee", "customer", "product", "message_author", "team_structure")


def typed_claims(objects: DataFrame, attributes: DataFrame, links: DataFrame, by_source: DataFrame, by_external: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """claims (subject, predicate, kind, value, source), organisations (entity, name) and gaps (source, predicate, external, reason).

    objects: source, type. attributes: source, field, value. links: source, field, external, a row each, so that no list has to fit a task.
    by_source: source, entity. by_external: namespace, external, entity. Objects that are no entity are a gap (subject_unresolved) and have no claims;
    links whose id is unknown are (object_unresolved), and types without rules (unsupported_object_type). Empty values have no claim.
    """
    spark = objects.sparkSession
    rules = spark.createDataFrame([(*k, p, "literal") for k, p in LITERALS.items()] + [(*k, p, "entity") for k, p in ORGANISATIONS.items()], "type string, field string, predicate string, kind string")
    linked = spark.createDataFrame([(*k, *v) for k, v in LINKS.items()], "type string, field string, predicate string, namespace string")
    own = objects.select("source", "type").distinct().join(by_source.groupBy("source").agg(F.min("entity").alias("subject")), "source", "left")
    known = own.where("subject IS NOT NULL")
    values = known.join(attributes.where("trim(value) <> ''"), "source").join(F.broadcast(rules), ["type", "field"])
    organisation = stable_id("organization", canonical_json({"name": collapsed(F.col("value"))}))
    valued = values.select("subject", "predicate", "kind", F.when(F.col("kind") == "entity", organisation).otherwise(F.col("value")).alias("value"), "source")
    organisations = values.where("kind = 'entity'").groupBy(organisation.alias("entity")).agg(F.min("value").alias("name"))
    led = known.join(links.where("external IS NOT NULL"), "source").join(F.broadcast(linked), ["type", "field"]).join(by_external.groupBy("namespace", "external").agg(F.min("entity").alias("entity")), ["namespace", "external"], "left")
    claims = valued.unionByName(led.where("entity IS NOT NULL").select("subject", "predicate", F.lit("entity").alias("kind"), F.col("entity").alias("value"), "source")).distinct()
    gap = lambda df, predicate, external, reason: df.select("source", predicate.alias("predicate"), external.alias("external"), F.lit(reason).alias("reason"))
    every, none = F.lit("*"), F.lit(None).cast("string")
    gaps = gap(own.where("subject IS NULL"), every, none, "subject_unresolved").unionByName(gap(known.where(~F.col("type").isin(*TYPES)), every, none, "unsupported_object_type")).unionByName(gap(led.where("entity IS NULL"), F.col("predicate"), F.col("external"), "object_unresolved"))
    return claims, organisations, gaps.distinct()


def claim_id(with_source: bool) -> Column:
    """A claim's identity, with its source or without it, in which case corroborating claims share it."""
    fields = {k: F.col(k).cast("string") for k in KEYS} | ({"source": F.col("source")} if with_source else {})
    return stable_id("claim", canonical_json(fields))


def consolidate(observations: DataFrame) -> DataFrame:
    """One claim for equal observations of one source: claim, KEYS, source, first_observation, observations."""
    keyed = observations.withColumn("claim", claim_id(True))
    return keyed.groupBy("claim", *KEYS, "source").agg(F.min("observation").alias("first_observation"), F.count(F.lit(1)).alias("observations"))


def corroborations(claims: DataFrame) -> DataFrame:
    """Statements that several sources make: statement, KEYS, sources, first_claim.

    A statement stands for its pairs of claims, so one that a third of all sources repeat costs its rows alone.
    """
    return claims.groupBy(claim_id(False).alias("statement"), *KEYS).agg(F.count_distinct("source").alias("sources"), F.min("claim").alias("first_claim")).where("sources > 1")


def answer_groups(claims: DataFrame) -> DataFrame:
    """subject, predicate, answer (a normal form with its type in front), label (its least spelling), claims, sources.

    Entities are named by their id, texts in compatibility form, collapsed, and other literals as they are.
    """
    kind = F.lower(F.coalesce(F.col("datatype"), F.lit("string"))) if "datatype" in claims.columns else F.lit("string")
    text = kind.isin("string", "text")
    answer = F.when(text, collapsed(nfkc(F.col("value")))).otherwise(F.trim("value"))
    return claims.groupBy("subject", "predicate", F.concat(F.when(text, "string").otherwise(kind), F.lit(":"), answer).alias("answer")).agg(F.min("value").alias("label"), F.count_distinct("claim").alias("claims"), F.count_distinct("source").alias("sources"))


def relation(left: str = "l", right: str = "r", aligned: Column | None = None) -> Column:
    """What two claims are to each other: equivalent, corroboration, supersession, contradiction, or incomparable where they aren't ``aligned``.

    Values are the same if their datatypes are too. ``aligned`` says whether subject and predicate are (by default: they are).
    """
    at = lambda side, c: F.col(f"{side}_{c}")
    over = (at(left, "valid_to") <= at(right, "valid_from")) | (at(right, "valid_to") <= at(left, "valid_from"))
    same = equal_objects(left, right)
    kinds = F.when(same & at(left, "source").eqNullSafe(at(right, "source")), "equivalent").when(same, "corroboration").when(F.coalesce(over, F.lit(False)), "supersession").otherwise("contradiction")
    return kinds if aligned is None else F.when(~F.coalesce(aligned, F.lit(False)), "incomparable").otherwise(kinds)


def equal_objects(left: str = "l", right: str = "r") -> Column:
    """Whether two claims' values are the same, of the same datatype; nulls are equal."""
    return F.col(f"{left}_value").eqNullSafe(F.col(f"{right}_value")) & F.col(f"{left}_datatype").eqNullSafe(F.col(f"{right}_datatype"))


#: What is compared of a claim.
COMPARED = ("claim", "value", "datatype", "source", "system", "observed", "valid_from", "valid_to")


def conflicts(claims: DataFrame, group: list[str]) -> DataFrame:
    """All pairs of claims of a group with different values, of different sources and systems: group, l_/r_ columns and relation.

    No claim stands for another: a group costs its pairs, since they are the result. A claim without a source is of a source of its own.
    """
    side = lambda x: claims.select(*group, *(F.col(f).alias(f"{x}_{f}") for f in COMPARED))
    pairs = side("l").join(side("r"), group).where("l_claim < r_claim AND l_system <> r_system AND NOT coalesce(l_source = r_source, false)")
    return pairs.where(~equal_objects()).withColumn("relation", relation())


def adjudicate(pairs: DataFrame, trust: DataFrame, lifecycles: DataFrame | None = None, recency: DataFrame | None = None) -> DataFrame:
    """pairs with ``winner`` (left, right or unresolved) and ``decided_by``: the first decisive tier of authority, lifecycle, recency.

    trust: predicate, system, priority. Where a side has none, authority can't compare them. lifecycles: predicate, lifecycle, rank; it
    counts where both sides' lifecycle (l_lifecycle, r_lifecycle) is grounded, that is, not null. recency: the predicates with a policy
    that newer claims win; without this table they win where both sides have the same priority. ``decided_by`` of unresolved pairs is
    ``no_policy`` where no table has anything for both sides, else ``no_decisive_rule``. All three are tables of rules, which Spark sends to all tasks if they are small.
    """
    t = lambda x: trust.select("predicate", F.col("system").alias(f"{x}_system"), F.col("priority").alias(f"{x}_priority"))
    joined = pairs.join(t("l"), ["predicate", "l_system"], "left").join(t("r"), ["predicate", "r_system"], "left")
    wins = lambda a, b: F.when(F.col(a) > F.col(b), "left").when(F.col(b) > F.col(a), "right")
    comparable = F.col("l_priority").isNotNull() & F.col("r_priority").isNotNull()
    by_stage, ranked = F.lit(None).cast("string"), F.lit(False)
    if lifecycles is not None:
        for x in "lr":
            joined = joined.join(lifecycles.select("predicate", F.col("lifecycle").alias(f"{x}_lifecycle"), F.col("rank").alias(f"{x}_rank")), ["predicate", f"{x}_lifecycle"], "left")
        by_stage, ranked = wins("l_rank", "r_rank"), F.col("l_rank").isNotNull() & F.col("r_rank").isNotNull()
    timely = F.col("l_priority") == F.col("r_priority")
    if recency is not None:
        joined = joined.join(recency.select("predicate", F.lit(True).alias("recent")).distinct(), "predicate", "left")
        timely = F.col("recent")
    by_trust, by_time = wins("l_priority", "r_priority"), F.when(timely, wins("l_observed", "r_observed"))
    none = ~(comparable | ranked | F.coalesce(timely, F.lit(False)))
    decided = F.when(by_trust.isNotNull(), "authority").when(by_stage.isNotNull(), "lifecycle").when(by_time.isNotNull(), "recency").when(none, "no_policy").otherwise("no_decisive_rule")
    return joined.withColumn("winner", F.coalesce(by_trust, by_stage, by_time, F.lit("unresolved"))).withColumn("decided_by", decided)


def losers(adjudicated: DataFrame, group: list[str]) -> DataFrame:
    """group, claim of the claims that lose a pair, each once."""
    lost = F.when(F.col("winner") == "left", F.col("r_claim")).when(F.col("winner") == "right", F.col("l_claim"))
    return adjudicated.select(*group, lost.alias("claim")).where("claim IS NOT NULL").distinct()


def verdicts(groups: DataFrame) -> DataFrame:
    """groups with ``verdict``, ``reason`` and ``answers``: from identity, open conflicts, claims and covered, in this order of precedence.

    Expects booleans ``identified``, ``covered`` and counts ``claims``, ``open_conflicts``, ``lost`` (claims that lost a conflict); nulls
    count as false and 0. ``answers`` counts the claims that a supported answer rests on: those that lost none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pick = lambda unnamed, disputed, supported, absent, unknown: F.when(~yes("identified"), unnamed).when(n("open_conflicts") > 0, disputed).when(n("claims") > 0, supported).when(yes("covered"), absent).otherwise(unknown)
    lost = n("lost") if "lost" in groups.columns else F.lit(0)
    out = groups.withColumn("verdict", pick("UNKNOWN", "DISPUTED", "SUPPORTED", "NOT_FOUND", "UNKNOWN"))
    out = out.withColumn("reason", pick("identity_missing", "claims_disputed", "claim_supported", "evidence_absent", "coverage_incomplete"))
    return out.withColumn("answers", F.when(F.col("verdict") == "SUPPORTED", n("claims") - lost).otherwise(0))


def ablations(groups: DataFrame) -> DataFrame:
    """ablation, verdict and how many groups have it, with each input of ``verdicts`` taken away in turn."""
    changes = {
        "none": {}, "no_identity": {"identified": F.lit(False)}, "no_conflicts": {"open_conflicts": F.lit(0)}, "no_claims": {"claims": F.lit(0), "open_conflicts": F.lit(0)},
        "no_coverage": {"covered": F.lit(False)}, "no_claims_no_coverage": {"claims": F.lit(0), "open_conflicts": F.lit(0), "covered": F.lit(False)},
    }
    names = ("identified", "covered", "claims", "open_conflicts")
    kind = {"identified": "boolean", "covered": "boolean", "claims": "bigint", "open_conflicts": "bigint"}
    each = F.array(*(F.struct(F.lit(a).alias("ablation"), *(c.get(n, F.col(n)).cast(kind[n]).alias(n) for n in names)) for a, c in changes.items()))
    return verdicts(groups.select(F.explode(each).alias("g")).select("g.*")).groupBy("ablation", "verdict").agg(F.count(F.lit(1)).alias("groups"))
