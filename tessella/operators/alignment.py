"""Alignment of source fields to terms of an ontology, by tables of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import slug


def source_terms(observed: DataFrame, hints: DataFrame) -> DataFrame:
    """system, object_type, field, target: by the hint of (system, object_type, field), else of the field in any, else UNMAPPED.

    Hints are a rule table: (system, object_type, field, target), with null system and object_type for any.
    """
    own = hints.where("system IS NOT NULL").select("system", "object_type", F.col("field").alias("surface"), F.col("target").alias("own"))
    generic = hints.where("system IS NULL").groupBy(F.col("field").alias("surface")).agg(F.min("target").alias("generic"))
    terms = observed.select("system", "object_type", "field").distinct().withColumn("surface", slug(F.col("field")))
    found = terms.join(own, ["system", "object_type", "surface"], "left").join(generic, "surface", "left")
    return found.select("system", "object_type", "field", "surface", F.coalesce("own", "generic", F.lit("UNMAPPED")).alias("target"))


def alignment_decisions(terms: DataFrame, ontology: DataFrame, rules: DataFrame) -> DataFrame:
    """terms with status and constraint: pending without a rule, rejected where target, domain or range don't fit the rule, else accepted.

    ontology: target, domain, range. rules: surface, target, domain, range.
    """
    rule = rules.select("surface", F.col("target").alias("rt"), F.col("domain").alias("rd"), F.col("range").alias("rr"))
    joined = terms.join(ontology, "target", "left").join(rule, "surface", "left")
    against = F.when(F.col("target") != F.col("rt"), "target_mismatch").when(~F.col("domain").eqNullSafe(F.col("rd")), "domain_mismatch").when(~F.col("range").eqNullSafe(F.col("rr")), "range_mismatch")
    status = F.when(F.col("rt").isNull(), "pending").when(against.isNotNull(), "rejected").otherwise("accepted")
    return joined.select("system", "object_type", "field", "surface", "target", status.alias("status"), F.when(F.col("rt").isNotNull(), against).alias("constraint"))


def coverage_gaps(required: DataFrame, slices: DataFrame) -> DataFrame:
    """required (system, object_type, predicate) with gap: why it isn't covered, null where it is.

    slices: system, object_type, status, predicates. In order: no slice, only failed ones, none complete, not examined.
    """
    own = slices.join(F.broadcast(required.select(F.col("system"), "object_type", "predicate").distinct()), ["system", "object_type"], "right")
    has = F.array_contains("predicates", F.col("predicate"))
    state = own.groupBy("system", "object_type", "predicate").agg(
        F.count("status").alias("n"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.bool_or((F.col("status") == "complete") & has), F.lit(False)).alias("examined")
    )
    gap = F.when(F.col("n") == 0, "slice_missing").when((F.col("complete") == 0) & (F.col("failed") > 0), "ingestion_failed").when(F.col("complete") == 0, "ingestion_incomplete").when(~F.col("examined"), "predicate_not_examined")
    return state.select("system", "object_type", "predicate", gap.alias("gap"))
