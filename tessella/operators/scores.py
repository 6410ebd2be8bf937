"""Reports over attempts and their labels, arms of an experiment, and what explains their losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import f1, ratio
from tessella.operators.quality import nearest_rank, set_overlap

#: The arms of the experiment, and for each what is removed from the context.
ARMS = {
    "plain_retrieval": None, "random_matched_removal": "drawn", "superseded_evidence_removal": "superseded", "current_evidence_pinning": "not_current", "full_grounding": "superseded",
    "prompt_only_conflict_reconciliation": None, "no_hydra": None, "no_identity_resolution": "superseded", "no_ontology_alignment": "superseded", "no_conflict_policy": None,
}
FULL = "full_grounding"


def _abstains(x: Column) -> Column:
    return F.coalesce(x.isin("UNKNOWN", "DISPUTED"), F.lit(False))


def _share(n: Column, d: Column) -> Column:
    """n / d, 0 where there is nothing to divide by."""
    return F.coalesce(ratio(n, d), F.lit(0.0))


def case_report(cases: DataFrame, by: list[str], expected: str, actual: str, expected_evidence: str, evidence: str, latency: str) -> DataFrame:
    """by, cases, verdict_accuracy, evidence_recall, invalid_extra_rate, p50, p95: evidence counts are of sets, latencies by nearest rank.

    Null latencies don't count; ratios without a denominator are null.
    """
    e = set_overlap(cases, expected_evidence, evidence)
    hits, misses, extras = (F.sum(c) for c in ("hits", "misses", "extras"))
    right = F.count_if(F.col(expected).eqNullSafe(F.col(actual)))
    p = lambda q: F.coalesce(nearest_rank(latency, q), F.lit(0.0))
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), ratio(right, F.count(F.lit(1))).alias("verdict_accuracy"), ratio(hits, hits + misses).alias("evidence_recall"), ratio(extras, hits + extras).alias("invalid_extra_rate"), p(50).alias("p50"), p(95).alias("p95"))


def attempt_report(labels: DataFrame, attempts: DataFrame, case: str, by: list[str]) -> DataFrame:
    """by and the measures of attempts against labels; a label without a completed attempt counts as answered wrongly, never left out.

    labels: case, facts, verdict, evidence, relationships, forbidden, coverage, proof (whether a live one is required), conflict, identity,
    alignment (states; ``not_applicable`` ones don't count). attempts: case, by, status and the same columns for what was found, with ``proof``
    whether there is a live one, accepted and rejected (groundings) and latency; one attempt a case and group of ``by``.
    Counts of attempts, groundings and latencies are over all attempts, those without a label too.
    """
    fields = ["facts", "verdict", "evidence", "relationships", "coverage", "proof", "conflict", "identity", "alignment"]
    groups = attempts.select(*by).distinct()
    want = labels.select(case, *(F.col(c).alias(f"e_{c}") for c in [*fields, "forbidden"])).crossJoin(F.broadcast(groups)) if by else labels.select(case, *(F.col(c).alias(f"e_{c}") for c in [*fields, "forbidden"]))
    keys = [case, *by]
    done = attempts.where("status = 'completed'").select(*(F.col(k).alias(f"a_{k}") for k in keys), F.lit(True).alias("done"), *fields)
    j = want.join(done, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in keys)), "left")
    j = set_overlap(j, "e_facts", "facts").withColumnsRenamed({"hits": "f_hits", "misses": "f_misses", "extras": "f_extras"})
    j = set_overlap(j, "e_evidence", "evidence")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok = F.col("done").isNotNull()
    exact = ok & (F.col("f_misses") == 0) & (F.col("f_extras") == 0)
    complete = F.when(~ok, 0.0).when(F.col("f_hits") + F.col("f_misses") == 0, F.when(F.col("f_extras") == 0, 1.0).otherwise(0.0)).otherwise(F.col("f_hits") / (F.col("f_hits") + F.col("f_misses")))
    related = ok & yes(F.col("e_relationships") == F.col("relationships")) & ~yes(F.arrays_overlap("e_forbidden", "relationships"))
    proven = ok & (~yes(F.col("e_proof")) | yes(F.col("proof")))
    applies = lambda c: yes(F.col(f"e_{c}") != "not_applicable")
    same = lambda c: ok & yes(F.col(f"e_{c}") == F.col(c))
    expects, detects = F.col("e_conflict") != "none", ok & yes(~F.col("conflict").isin("none", "not_applicable"))
    settled = F.col("e_conflict").isin("resolved", "unresolved")
    n, count, total = F.count(F.lit(1)), F.count_if, F.sum
    hits, misses, extras = total("hits"), total("misses"), total("extras")
    precision, recall = ratio(hits, hits + extras), ratio(hits, hits + misses)
    silent, wanted = _abstains(F.col("verdict")), _abstains(F.col("e_verdict"))
    scored = j.groupBy(*by).agg(
        n.alias("labels"), ratio(count(exact), n).alias("answer_correctness"), ratio(total(complete), n).alias("answer_completeness"), ratio(count(same("verdict")), n).alias("verdict_accuracy"), precision.alias("evidence_precision"), recall.alias("evidence_recall"), f1(precision, recall).alias("evidence_f1"),
        ratio(extras, hits + extras).alias("invalid_extra_rate"), ratio(count(related), n).alias("relationship_accuracy"), ratio(count(same("coverage")), n).alias("coverage_accuracy"), ratio(count(proven), n).alias("proof_accuracy"), ratio(count(applies("conflict") & (expects == detects)), count(applies("conflict"))).alias("conflict_detection"),
        ratio(count(settled & same("conflict")), count(settled)).alias("conflict_resolution"), ratio(count(applies("identity") & same("identity")), count(applies("identity"))).alias("identity_accuracy"), ratio(count(applies("alignment") & same("alignment")), count(applies("alignment"))).alias("alignment_accuracy"),
        ratio(count(silent & wanted), count(silent)).alias("abstention_precision"), ratio(count(silent & wanted), count(wanted)).alias("abstention_recall"),
    )
    known = attempts.join(labels.select(case, F.lit(True).alias("known")).distinct(), case, "left")
    finished = F.col("status") == "completed"
    accepted, rejected = total(F.when(finished, F.col("accepted")).otherwise(0)), total(F.when(finished, F.col("rejected")).otherwise(0))
    p = lambda q: nearest_rank("latency", q).alias(f"p{q}")
    counted = known.groupBy(*by).agg(n.alias("attempted"), count(finished).alias("completed"), count(F.col("status") == "rejected").alias("refused"), count(F.col("status") == "failed").alias("failed"), count(F.col("known").isNull()).alias("unscored"), accepted.alias("grounded"), rejected.alias("ungrounded"), ratio(accepted, accepted + rejected).alias("grounding_rate"), p(50), p(95))
    if not by:
        return scored.crossJoin(F.broadcast(counted))
    named = counted.withColumnsRenamed({k: f"a_{k}" for k in by})
    return scored.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in by))).drop(*(f"a_{k}" for k in by))


def lane_score(cases: DataFrame, by: list[str], status: str, correct: str, completeness: str, malformed: str) -> DataFrame:
    """by, attempted, answered, correctness, completeness (both over attempted), malformed_rate (over answered): a lane whose verdict is always to be SUPPORTED."""
    n, answered = F.count(F.lit(1)), F.count_if(F.col(status) == "completed")
    done = F.col(status) == "completed"
    return cases.groupBy(*by).agg(n.alias("attempted"), answered.alias("answered"), _share(F.count_if(done & F.col(correct)), n).alias("correctness"), _share(F.sum(F.when(done, F.col(completeness)).otherwise(0.0)), n).alias("completeness"), _share(F.count_if(done & F.col(malformed)), answered).alias("malformed_rate"))


def accepted_class(decisions: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 of the class ``accepted`` against ``rejected``; pending ones count on neither side, and as ``agreed`` or ``undecided``."""
    t, g = F.col(truth), F.col(guess)
    sure = t.isin("accepted", "rejected") & g.isin("accepted", "rejected")
    tp, fp, fn = (F.count_if(sure & (t == a) & (g == b)) for a, b in (("accepted", "accepted"), ("rejected", "accepted"), ("accepted", "rejected")))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return decisions.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), F.count_if((t == "pending") & (g == "pending")).alias("agreed"), F.count_if((t == "pending") != (g == "pending")).alias("undecided"))


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a set of rows against another; 0, not null, where there is nothing to divide by."""
    g, p = gold.select(*keys, F.lit(1).alias("g")).distinct(), predicted.select(*keys, F.lit(1).alias("p")).distinct()
    both = g.join(p, keys, "full").agg(*(F.count_if(c).alias(n) for n, c in (("tp", F.col("g").isNotNull() & F.col("p").isNotNull()), ("fp", F.col("g").isNull()), ("fn", F.col("p").isNull()))))
    scored = both.select("*", _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def arm_deltas(scores: DataFrame, arm: str, baseline: str, measures: list[str]) -> DataFrame:
    """arm and by how much each measure differs from the baseline arm's, to 12 decimals."""
    base = scores.where(F.col(arm) == baseline).select(*(F.col(m).alias(f"b_{m}") for m in measures))
    return scores.crossJoin(F.broadcast(base)).select(arm, *(F.round(F.col(m) - F.col(f"b_{m}"), 12).alias(f"{m}_delta") for m in measures))


def causal_arms(contexts: DataFrame, pool: DataFrame, case: str, item: str, seed: str) -> DataFrame:
    """case, arm, item, replacement: what each of ``ARMS`` removes from each case's context, and the stand-in of as many tokens.

    contexts: case, item, place (from 1), tokens, current, superseded (booleans). pool: case, item, tokens. The drawn item depends on the seed and the
    case alone. Stand-ins are taken from the end of the pool, each once, never from the context; null is a removal that can't be matched, which breaks the arm.
    """
    sizes = contexts.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col(case)), 256), 1, 8), 16, 10).cast("bigint"), F.col("n")) + 1
    marked = contexts.join(sizes, case).select(case, item, "place", "tokens", (F.col("place") == draw).alias("drawn"), "superseded", (~F.col("current")).alias("not_current"))
    each = [F.struct(F.lit(a).alias("arm"), F.col(what).alias("gone")) for a, what in ARMS.items() if what]
    gone = marked.select(case, item, "place", "tokens", F.explode(F.array(*each)).alias("a")).select(case, item, "place", "tokens", "a.arm", "a.gone").where("gone")
    spare = pool.select(case, item, "tokens").join(contexts.select(case, item), [case, item], "left_anti")
    nth = gone.withColumn("k", F.row_number().over(Window.partitionBy(case, "arm", "tokens").orderBy("place")))
    stand_in = spare.select(case, "tokens", F.col(item).alias("replacement"), F.row_number().over(Window.partitionBy(case, "tokens").orderBy(F.col(item).desc())).alias("k"))
    return nth.join(stand_in, [case, "tokens", "k"], "left").select(case, "arm", item, "replacement")


def loss_diagnosis(runs: DataFrame, case: str, arm: str, signature: Column, budget: str, status: str, timed_out: Column, missing: DataFrame, removed: DataFrame) -> DataFrame:
    """case, category of what may explain the losses of each case that has one run of every arm; others have the category ``incomplete``.

    missing: case, n (conflicting records that retrieval left out). removed: case, n (records that the full arm removes).
    """
    r = runs.where(F.col(arm).isin(*ARMS)).select(case, arm, signature.alias("s"), budget, status, timed_out.alias("late"))
    sign = lambda a: F.max(F.when(F.col(arm) == a, F.col("s")))
    by = r.groupBy(case).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(arm).alias("arms"), sign(FULL).alias("full"), *(sign(a).alias(a) for a in ("no_conflict_policy", "no_identity_resolution", "no_ontology_alignment")), (F.count_distinct(F.coalesce(F.col(budget), F.lit(-1)))).alias("budgets"), F.bool_or(F.coalesce("late", F.lit(False))).alias("late"), F.bool_or(F.col(status) == "rejected").alias("refused"))
    j = by.join(missing.select(case, F.col("n").alias("missing")), case, "left").join(removed.select(case, F.col("n").alias("removed")), case, "left")
    whole = (F.col("rows") == len(ARMS)) & (F.col("arms") == len(ARMS))
    differs = lambda a: ~F.col("full").eqNullSafe(F.col(a))
    found = {"retrieval": F.col("missing") > 0, "conflict-policy": (F.coalesce("removed", F.lit(0)) > 0) | differs("no_conflict_policy"), "identity": differs("no_identity_resolution"), "alignment": differs("no_ontology_alignment"), "context-budget": F.col("budgets") > 1, "model-timeout": F.col("late"), "scorer-failure": F.col("refused")}
    categories = F.filter(F.array(F.when(~whole, "incomplete"), *(F.when(whole & F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in found.items())), lambda x: x.isNotNull())
    return j.select(case, F.explode(categories).alias("category"))
