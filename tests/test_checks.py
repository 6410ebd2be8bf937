"""Checks, reports and the evidence graph on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import checks as K
from tessella.operators import claims
from tessella.operators import evidence as E
from tessella.operators import scores as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def values(spark, column, *texts, kind="string"):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], f"x {kind}").select(column).collect()]


def test_json_is_searched_digested_and_read_at_any_depth(spark):
    bad = json.dumps({"a": [{"b": {"gold_answer": 1}}]})
    assert values(spark, K.forbidden_path(F.col("x")), bad, '{"a": "gold_answer"}', "{", None) == ["$.a[0].b.gold_answer", None, None, None]
    assert values(spark, K.forbidden_path(F.col("x"), texts=True), '{"a": ["x gold_answer"]}') == ["$.a[0]"]
    a, b, c, d = values(spark, K.json_digest(F.col("x")), '{"a":1,"b":[2, 3]}', '{ "b": [2,3], "a": 1 }', '{"a":1,"b":[3,2]}', "{")
    assert a == b != c and d is None
    assert values(spark, K.json_at(F.col("x"), "/a/0/b~1c"), '{"a": [{"b/c": [1]}]}', '{"a": []}', None) == ["[1]", None, None]
    assert values(spark, K.json_normal(F.col("x")), '{"b": " X  y ", "a": [1, {"C": "D"}]}') == ['{"a":[1,{"C":"d"}],"b":"x y"}']
    assert values(spark, K.timed_keys(F.col("x")), {"updated_at": "1", "name": "n", "createdAt": "2"}, kind="map<string,string>") == [{"createdAt": "2", "updated_at": "1"}]


def test_values_and_quotes(spark):
    df = spark.createDataFrame([("5", "limit is 5."), ("5", "limit is 15"), ("5", "5.5 GB"), ("Ｆull Name", "the FULL  name here"), ("true", "untrue"), ("", "x"), (None, "x")], "v string, q string")
    assert [r[0] for r in df.select(K.value_in_quote("v", "q")).collect()] == [True, False, False, True, False, False, False]
    o = spark.createDataFrame([("a_b", "5", "is 5", "it is 5 now"), ("A b", "5", "is 5", "is 5"), ("a", "5", "was 5", "is 5"), ("a", "6", "is 5", "is 5"), ("a", " ", "is 5", "is 5"), ("a", "5", None, "is 5")], "p string, v string, q string, s string")
    assert [r[0] for r in o.select(K.observation_fault(*map(F.col, "pvqs"))).collect()] == [None, "predicate", "ungrounded_quote", "ungrounded_value", "value", "quote"]
    g = spark.createDataFrame([("r1", None), ("r1", "ungrounded_value"), ("r2", None), ("r3", "malformed")], "r string, f string")
    assert rows(K.grounded_responses(g, "r", "f").select("r", "status", "reason")) == [("r1", "rejected", "ungrounded_output"), ("r2", "accepted", None), ("r3", "rejected", "malformed_output")]


def test_facts_hints_and_labels(spark):
    assert [tuple(x) if x else None for x in values(spark, K.numeric_fact(F.col("x")), "12.5%", "about 30 mins", "5 ms", "none", None)] == [("percentage", 12.5, None), ("duration", 30.0, "minutes"), ("duration", 5.0, "milliseconds"), None, None]
    assert values(spark, K.subject_hint(F.col("x"), F.lit("q1")), "limit of pay-12-eu now", "no name") == ["pay-12-eu", "q1"]
    assert values(spark, K.naive_target(F.col("x")), "Owner", "assignee", "Next Step") == ["OWNS", "ASSIGNED_TO", "NEXT_STEP"]
    assert values(spark, K.evidence_id(F.lit("quote"), F.col("x")), "jira · ENG-1", "plain") == ["ENG-1", "plain"]
    assert values(spark, K.evidence_id(F.col("x"), F.lit("a · b")), " source_object_0af ") == ["source_object_0af"]
    assert values(spark, K.person_names(F.col("x")), "ask Ida Berg Olsen or Bob") == [["Ida Berg Olsen"]]
    assert values(spark, K.section_label(F.col("x"), "Goals (all)"), "intro\nGoals (all):\n- x", "| a | Goals (all) | b", "x Goals (all)", r"a\ngoals (all)\n") == [True, True, False, True]
    log = "x\ncompletion done tokens=5 ttft=12.5ms tps=3.1 prompt=7 cache=2 gen=5 backend=gpu\ncompletion done tokens=broken"
    assert [tuple(r) for r in values(spark, K.log_requests(F.col("x")), log)[0]] == [(5, 7, 2, 12.5, 3.1, "gpu")]


def test_anchors_are_taken_back_nearby_only(spark):
    score = K.anchor_score(F.col("x"), F.array(F.lit("ENG-1")))
    assert values(spark, score, "eng-1 applies", "not eng-1", "eng-1 and Eng-1", "eng-1" + " " * 60 + "deprecated", "other", "") == [6, -10, 12, 6, 0, 0]


def test_requests_manifests_labels_and_holdouts(spark):
    df = spark.createDataFrame([("what is it?", "Ida", "p_q", "a"), ("short", "Ida", "p", "a"), ("what is it?", "", "p", "a"), ("what is it?", "Ida", "P", "a"), ("what is it?", "Ida", "p", "z")], "q string, e string, p string, s string")
    assert [r[0] for r in df.select(K.request_fault(*map(F.col, "qeps"), ["a"])).collect()] == [None, "question", "entity", "predicate", "scope"]
    labels = spark.createDataFrame([("a", "SUPPORTED", [1]), ("b", "SUPPORTED", []), ("c", "MAYBE", [1]), ("d", "UNKNOWN", []), ("d", "UNKNOWN", []), (None, "UNKNOWN", [])], "k string, v string, e array<int>")
    assert rows(K.label_faults(labels, "k", "v", "e").select("k", "fault")) == [("a", None), ("b", "evidence"), ("c", "verdict"), ("d", "repeated"), ("d", "repeated"), (None, "no_key")]
    listed, runs = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "k string")
    assert rows(K.accounting_faults(listed, runs, "k")) == [("b", "run_again"), ("c", "not_run"), ("x", "unlisted")]


def test_promotions(spark):
    kind = "c string, id string, status string, subject string, value string, score int, dated date, asks_latest boolean, at int"
    x = [("c1", "a", "accepted", "s", "1", 3, None, False, 1), ("c1", "b", "accepted", "s", "2", 0, None, False, 2), ("c1", "z", "accepted", "s", "9", 99, None, False, 3), ("c2", "a", "accepted", "s", "1", 1, None, False, 1), ("c2", "b", "rejected", "s", "2", 0, None, False, 2),
         ("c3", "a", "accepted", "s", "1", 1, None, False, 1), ("c3", "b", "accepted", "t", "2", 0, None, False, 2), ("c4", "a", "accepted", "s", "X  1", 1, None, False, 1), ("c4", "b", "accepted", "s", "x 1", 0, None, False, 2), ("c5", "a", "accepted", "s", "1", 1, None, False, 1), ("c5", "b", "accepted", "s", "2", 0, None, False, 2)]
    got = K.promotions(spark.createDataFrame(x, kind), "c", ["at"])
    assert rows(got.select("c", "skipped", "winner", "reason")) == [("c1", None, "left", "precedence"), ("c2", "needs_two_extractions", None, None), ("c3", "subject_mismatch", None, None), ("c4", "no_contradiction", None, None), ("c5", None, "unresolved", "insufficient_margin")]
    later = spark.createDataFrame([("c", "a", "accepted", "s", "1", 3, None, True, 1), ("c", "b", "accepted", "s", "2", 0, None, True, 2)], kind).withColumn("dated", F.when(F.col("at") == 1, F.lit("2024-01-01")).otherwise(F.lit("2025-01-01")).cast("date"))
    assert K.promotions(later, "c", ["at"]).first()["winner"] == "right"


EDGES = [("A", "1", "2"), ("B", "2", "3"), ("A", "2", "4"), ("A", "4", "1"), ("B", "4", "3"), ("A", "1", "4"), ("C", "1", "3")]


def test_whole_paths(spark):
    e = spark.createDataFrame([(*x, None) for x in EDGES], "type string, src string, dst string, role string")
    asked = spark.createDataFrame([("1", "3"), ("3", "1"), ("1", "9")], "start string, end string")
    found = E.paths(asked, e, ["A", "B"], 3, 2)
    assert [(r["hops"], r["nodes"], r["types"]) for r in found.orderBy("place").collect()] == [(2, ["1", "2", "3"], ["A", "B"]), (2, ["1", "4", "3"], ["A", "B"])]
    assert rows(E.requested_paths(asked, found).select("start", "end", "hops")) == [("1", "3", 2), ("1", "9", None), ("3", "1", None)]
    assert E.paths(asked, e, ["A", "B"], 3, 100).count() == 3 and E.paths(asked, e, ["B"], 3, 2).count() == 0
    for bad in ((0, 1), (17, 1), (3, 0), (3, 101)):
        with pytest.raises(ValueError):
            E.paths(asked, e, ["A"], *bad)
    start = spark.createDataFrame([("1",), ("2",), ("4",)], "id string")
    assert rows(E.sequence(start, e, ["A", "B"])) == [("1", None, "ambiguous"), ("2", ["2", "4", "3"], None), ("4", None, "missing")]
    nodes = spark.createDataFrame([("X", "1"), ("Y", "3")], "label string, id string")
    proofs = lambda *x: {r["fault"] for r in E.proof_faults(found, *x).collect()}
    assert proofs(["A", "B"], nodes, "X", "Y", 1, 3) == {None} and proofs(["A", "A"], nodes, "X", "Y", 1, 3) == {"relationships"} and proofs(["A", "B"], nodes, "X", "Z", 1, 3) == {"labels"} and proofs(["A", "B"], nodes, "X", "Y", 3, 3) == {"length"}


def test_conflict_and_identity_reads(spark):
    e = [("CONSIDERS", "k1", "a", "left"), ("CONSIDERS", "k1", "b", "right"), ("DECIDED_BY", "k1", "p", None), ("CONSIDERS", "k2", "a", "left"), ("CONSIDERS", "k2", "b", "right"), ("CONSIDERS", "k3", "a", "left"), ("CONSIDERS", "k4", "a", "left"), ("CONSIDERS", "k4", "a", "right"), ("CONSIDERS", "k5", "a", "left"), ("CONSIDERS", "k5", "b", "right"), ("DECIDED_BY", "k5", "p", None), ("RESOLVES_TO", "s1", "e1", None), ("RESOLVES_TO", "s2", "e1", None), ("RESOLVES_TO", "s2", "e2", None)]
    edges = spark.createDataFrame(e, "type string, src string, dst string, role string")
    said = spark.createDataFrame([("k1", "right"), ("k2", "left"), ("k3", "left"), ("k4", "unresolved"), ("k5", "unresolved")], "conflict string, resolution string")
    assert rows(E.conflict_decisions(edges, said).select("conflict", "winner", "fault")) == [("k1", "b", None), ("k2", "a", "undecided"), ("k3", "a", "sides"), ("k4", None, "same_claim"), ("k5", None, "needless_policy")]
    asked = spark.createDataFrame([("s1",), ("s2",), ("s3",), (None,)], "s string")
    assert rows(E.resolved_entities(edges, asked, "s")) == [("s1", "e1", None), ("s2", None, "ambiguous"), ("s3", None, "missing")]
    nodes = spark.createDataFrame([("E", "e1"), ("S", "s1"), ("S", "s2"), ("Z", "s2")], "label string, id string")
    assert rows(E.faults(nodes, edges.where("type = 'RESOLVES_TO'"))) == [("RESOLVES_TO", "target_missing", 1), ("node", "two_labels", 1)]


def test_reports_count_what_is_missing(spark):
    kind = "facts array<string>, verdict string, evidence array<string>, relationships array<string>, {f}coverage string, proof boolean, conflict string, identity string, alignment string"
    labels = spark.createDataFrame([("a", ["f"], "SUPPORTED", ["d1", "d2"], ["R"], ["X"], "complete", True, "none", "resolved", "not_applicable"), ("b", [], "UNKNOWN", [], [], [], "partial", False, "unresolved", "resolved", "not_applicable")], "c string, " + kind.format(f="forbidden array<string>, "))
    attempts = spark.createDataFrame([("a", "completed", ["f"], "SUPPORTED", ["d1", "d9"], ["R"], "complete", True, "none", "resolved", "not_applicable", 3, 1, 5.0), ("z", "failed", None, None, None, None, None, None, None, None, None, None, None, 9.0)], "c string, status string, " + kind.format(f="") + ", accepted int, rejected int, latency double")
    r = S.attempt_report(labels, attempts, "c", []).first()
    assert (r["labels"], r["attempted"], r["completed"], r["failed"], r["unscored"], r["answer_correctness"], r["answer_completeness"], r["verdict_accuracy"]) == (2, 2, 1, 1, 1, 0.5, 0.5, 0.5)
    assert (r["evidence_precision"], r["evidence_recall"], r["invalid_extra_rate"], r["relationship_accuracy"], r["proof_accuracy"], r["conflict_detection"], r["conflict_resolution"], r["identity_accuracy"], r["alignment_accuracy"]) == (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.0, 0.5, None)
    assert (r["abstention_precision"], r["abstention_recall"], r["grounding_rate"], r["p50"], r["p95"]) == (None, 0.0, 0.75, 5.0, 9.0)
    d = spark.createDataFrame([("accepted", "accepted"), ("rejected", "accepted"), ("accepted", "rejected"), ("pending", "accepted"), ("pending", "pending")], "t string, g string").withColumn("by", F.lit(1))
    assert tuple(S.accepted_class(d, "t", "g", ["by"]).first())[1:] == (1, 1, 1, 0.5, 0.5, 0.5, 1, 1)
    none = d.where("false").select("t")
    assert tuple(S.set_scores(none, none, ["t"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_arms_and_losses(spark):
    contexts = spark.createDataFrame([("c", 1, 1, 10, True, False), ("c", 2, 2, 10, False, True), ("c", 3, 3, 20, False, True)], "case string, doc int, place int, tokens int, current boolean, superseded boolean")
    pool = spark.createDataFrame([("c", i, t) for i, t in ((1, 10), (7, 10), (8, 10), (9, 30))], "case string, doc int, tokens int")
    by = {}
    for c, arm, doc, stand_in in rows(S.causal_arms(contexts, pool, "case", "doc", "seed")):
        by.setdefault(arm, {})[doc] = stand_in
    assert by["superseded_evidence_removal"] == {2: 8, 3: None} == by["full_grounding"] and by["current_evidence_pinning"] == {2: 8, 3: None} and len(by["random_matched_removal"]) == 1 and "plain_retrieval" not in by
    runs = [("c", a, "completed", "x" if a != "no_identity_resolution" else "y", 1) for a in S.ARMS] + [("d", "no_hydra", "completed", "x", 1)]
    df = spark.createDataFrame(runs, "case string, arm string, status string, verdict string, budget int")
    n = lambda *x: spark.createDataFrame(list(x), "case string, n int")
    found = S.loss_diagnosis(df, "case", "arm", F.col("verdict"), "budget", "status", F.lit(False), n(("c", 2)), n())
    assert rows(found) == [("c", "identity"), ("c", "retrieval"), ("d", "incomplete")]


def test_typed_claims_and_their_gaps(spark):
    frame = spark.createDataFrame
    objects = frame([("s1", "employee"), ("s2", "employee"), ("s3", "product"), ("s4", "channel")], "source string, type string")
    attributes = frame([("s1", "name", "Ida"), ("s1", "organization", " Edge  DELIVERY"), ("s1", "role", " "), ("s2", "name", "Bob"), ("s3", "name", "P")], "source string, field string, value string")
    links = frame([("s3", "team", "e1"), ("s3", "team", "e9"), ("s3", "team", None)], "source string, field string, external string")
    by_source = frame([("s1", "E1"), ("s3", "E3"), ("s4", "E4")], "source string, entity string")
    made, organisations, gaps = claims.typed_claims(objects, attributes, links, by_source, frame([("person", "e1", "E1")], "namespace string, external string, entity string"))
    assert rows(made.where("predicate <> 'member_of'").drop("source")) == [("E1", "display_name", "literal", "Ida"), ("E3", "display_name", "literal", "P"), ("E3", "has_team_member", "entity", "E1")]
    assert made.where("predicate = 'member_of'").first()["value"] == organisations.first()["entity"] and organisations.count() == 1
    assert rows(gaps) == [("s2", "*", None, "subject_unresolved"), ("s3", "has_team_member", "e9", "object_unresolved"), ("s4", "*", None, "unsupported_object_type")]
