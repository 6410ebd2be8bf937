"""Operators on small tables, against expectations worked out by hand or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import alignment, claims, components, contexts, graph, identity, intake, quality, ranking, retrieval


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbering_in_salted_runs(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, i) for i in range(7)] + [("b", 1)], "g string, x int")
    by = {}
    for g, _, k in rows(ranking.rank_in_group(df, ["g"], ["x"], 5)):
        by.setdefault(g, []).append(k)
    assert {g: sorted(v) for g, v in by.items()} == {"a": list(range(1, 51)), None: list(range(1, 8)), "b": [1]}


@pytest.mark.parametrize("seed", range(3))
def test_components_are_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(f"{r.randrange(150):03}", f"{r.randrange(150):03}") for _ in range(110)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges + [(None, "x")], "a string, b string"), "a", "b", spark.createDataFrame([("alone",)], "vertex string"))
    assert rows(got) == sorted([(x, root(x)) for x in parent] + [("alone", "alone")])
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_ledger_counts_repeats_and_rejects(spark):
    df = spark.createDataFrame([("r", "s", "1", "x", None), ("r", "s", "1", "x", None), ("r", "s", "1", "y", None), ("r", "s", None, None, "bad"), ("r", "t", None, None, "bad")], "run string, sys string, nat string, dig string, why string")
    assert rows(intake.ledger(df, "run", "sys", "nat", "dig", "why")) == [("r", "s", 2, 1, 1, 1, 1), ("r", "t", 0, 0, 1, 0, 0)]


def test_versions_and_duplicates(spark):
    df = spark.createDataFrame([("s", "n1", "d2", "i2", "k", "A b"), ("s", "n1", "d1", "i1", "k", "a  B"), ("s", "n1", "d1", "i3", "k", "z"), ("s", "n2", "d9", "i4", "k", "q"), ("s", None, "d7", "i5", "j", None)], "sys string, nat string, dig string, id string, kind string, body string")
    assert [(r["id"], r["is_anchor"]) for r in intake.version_groups(df, "sys", "nat", "dig", "id").orderBy("id").collect()] == [("i1", True), ("i2", False)]
    assert rows(intake.duplicate_pairs(df, "id", "kind", "nat", "dig", "body")) == [("i1", "i2", "version_candidate"), ("i1", "i3", "exact")]
    assert intake.version_groups(df.where("false"), "sys", "nat", "dig", "id").count() == 0


def test_all_payloads_of_a_native_id_are_linked(spark):
    x = [("s", "k", "n", "d1", "i1"), ("s", "k", "n", "d1", "i4"), ("s", "k", "n", "d2", "i3"), ("s", "k", "n", "d3", "i2"), ("t", "k", "n", "d4", "i0"), ("s", "j", "n", "d5", "i5"), ("s", "k", None, "d6", "i6"), ("s", "k", "n", None, "i7")]
    df = spark.createDataFrame(x, "sys string, kind string, nat string, dig string, id string")
    links = intake.version_links(df, "sys", "kind", "nat", "dig", "id")
    assert rows(links.select("left", "right")) == [("i1", "i2"), ("i1", "i3"), ("i2", "i3")]
    members = intake.payload_members(df, "sys", "kind", "nat", "dig", "id")
    assert rows(members.select("id", "representative")) == [("i0", "i0"), ("i1", "i1"), ("i2", "i2"), ("i3", "i3"), ("i4", "i1"), ("i5", "i5")]
    assert intake.version_links(df.where("false"), "sys", "kind", "nat", "dig", "id").count() == 0


def test_reasons_and_acquisition(spark):
    df = spark.createDataFrame([("a", "x"), ("", "x"), ("a", None)], "p string, q string")
    assert [r[0] for r in df.select(intake.rejected_for([("p", intake.required("p")), ("q", intake.required("q"))])).collect()] == [None, "p", "q"]
    have, lack = intake.acquire(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "k int, d string"), spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int"), "k", "d")
    assert rows(have) == [(1, "a"), (1, "b")] and rows(lack) == [(9,)]


def observed(spark, *x):
    return identity.identity_keys(spark.createDataFrame(list(x), "object string, kind string, namespace string, value string"))


def decided(spark, *x):
    keys = observed(spark, *x)
    s = identity.signals(keys)
    return {(r["left"], r["right"]): (r["status"], r["confidence"]) for r in identity.decide(s, identity.constraints(s, keys)).collect()}


def test_identity_signals_and_constraints(spark):
    assert decided(spark, ("a", "email", "x", "E@m"), ("b", "email", "y", " e@M ")) == {("a", "b"): ("accepted", 1.0)}
    assert decided(spark, ("a", "handle", "x", "h"), ("b", "handle", "y", "h")) == {}
    assert decided(spark, ("a", "name", "x", "N"), ("b", "name", "y", "n")) == {("a", "b"): ("pending", 0.35)}
    assert decided(spark, ("a", "name", "x", "N"), ("b", "name", "x", "n"), ("a", "external_id", "x", "1"), ("b", "external_id", "x", "2")) == {("a", "b"): ("rejected", 0.0)}
    assert decided(spark, ("a", "name", "x", "N"), ("b", "name", "x", "n"), ("a", "external_id", "x", "1"), ("b", "external_id", "y", "2")) == {("a", "b"): ("pending", 0.35)}
    assert decided(spark, ("a", "email", "x", "p"), ("b", "email", "x", "q"), ("a", "handle", "x", "h"), ("b", "handle", "x", "h"), (None, "email", "x", "p"), ("c", "email", "x", " ")) == {("a", "b"): ("rejected", 0.0)}


def test_a_chain_that_would_hold_two_ids_is_vetoed_in_order(spark):
    keys = observed(spark, ("a", "external_id", "x", "1"), ("c", "external_id", "x", "2"), ("d", "external_id", "x", "3"))
    d = spark.createDataFrame([("a", "b", "accepted"), ("b", "c", "accepted"), ("d", "e", "accepted"), ("d", "f", "pending")], "left string, right string, status string")
    assert rows(identity.vetoed_merge(d, keys)) == [("a", "b", "accepted"), ("b", "c", "rejected"), ("d", "e", "accepted")]


def test_reversal_undoes_the_last_decision(spark):
    d = spark.createDataFrame([("d1", "a", "b", "accepted", 1), ("d2", "b", "a", "reversed", 2), ("d3", "a", "c", "pending", 1), ("d4", "a", "c", "accepted", 3)], "decision string, left string, right string, status string, at int")
    assert [r["decision"] for r in identity.active_decisions(d).collect()] == ["d4"]
    e = identity.entities(identity.active_decisions(d), spark.createDataFrame([("a",), ("b",), ("c",)], "object string"))
    by = dict(rows(e))
    assert by["a"] == by["c"] != by["b"]


CLAIM = "observation string, claim string, subject string, predicate string, value string, datatype string, source string, system string, valid_from timestamp, valid_to timestamp, observed timestamp"


def claim_rows(spark, *x):
    return spark.createDataFrame([(i, i, "s", "p", v, "string", src, sy, None, None, None) for i, v, src, sy in x], CLAIM)


def test_consolidation_and_corroboration(spark):
    made = claims.consolidate(claim_rows(spark, ("o1", "v", "a", "j"), ("o2", "v", "a", "j"), ("o3", "v", "b", "k")))
    assert sorted((r["source"], r["first_observation"], r["observations"]) for r in made.collect()) == [("a", "o1", 2), ("b", "o3", 1)]
    assert [r["sources"] for r in claims.corroborations(made).collect()] == [2]


def test_conflicts_and_adjudication(spark):
    c = claim_rows(spark, ("c1", "v", "a", "jira"), ("c2", "w", "b", "slack"), ("c3", "v", "c", "slack"), ("c4", "w", "d", "slack"))
    found = claims.conflicts(c, ["subject", "predicate"])
    trust = spark.createDataFrame([("p", "jira", 5.0), ("p", "slack", 2.0)], "predicate string, system string, priority double")
    assert rows(claims.adjudicate(found, trust).select("l_claim", "r_claim", "relation", "winner", "decided_by")) == [("c1", "c2", "contradiction", "left", "authority"), ("c1", "c4", "contradiction", "left", "authority")]
    assert [r["decided_by"] for r in claims.adjudicate(found, trust.where("false")).collect()] == ["no_policy"] * 2


def test_all_claims_meet_in_conflicts(spark):
    x = [("c1", "v", "a", "jira", None, "2020-01-01", "2020-03-01"), ("c2", "v", "b", "jira", "2020-01-01", None, "2020-02-01"), ("c3", "w", "c", "slack", "2020-02-01", None, None), ("c4", "w", "a", "slack", None, None, None), ("c5", "w", "d", "jira", None, None, None), ("c6", "v", None, "wiki", None, None, None), ("c7", "u", None, "slack", None, None, None)]
    df = spark.createDataFrame([(i, i, "s", "p", v, "string", src, sy, a, b, o) for i, v, src, sy, a, b, o in x], "observation string, claim string, subject string, predicate string, value string, datatype string, source string, system string, valid_from string, valid_to string, observed string")
    found = claims.conflicts(df.withColumns({t: F.col(t).cast("timestamp") for t in ("valid_from", "valid_to", "observed")}), ["subject", "predicate"])
    expected = {("c1", "c3", "supersession"), *((*p.split(), "contradiction") for p in ("c1 c7", "c2 c3", "c2 c4", "c2 c7", "c3 c6", "c4 c6", "c5 c6", "c5 c7", "c6 c7"))}
    assert set(rows(found.select("l_claim", "r_claim", "relation"))) == expected and found.count() == len(expected)


def decided_pair(spark, l, r, trust, lifecycles=None, recency=None):
    """winner, decided_by of two claims (system, observed, lifecycle) of predicate p."""
    pair = spark.createDataFrame([("p", *l, *r)], "predicate string, l_system string, l_observed string, l_lifecycle string, r_system string, r_observed string, r_lifecycle string").withColumns({"l_claim": F.lit("a"), "r_claim": F.lit("b"), "relation": F.lit("contradiction")})
    rules = spark.createDataFrame(trust, "predicate string, system string, priority double")
    stages = None if lifecycles is None else spark.createDataFrame(lifecycles, "predicate string, lifecycle string, rank int")
    recent = None if recency is None else spark.createDataFrame([(x,) for x in recency], "predicate string")
    return tuple(claims.adjudicate(pair, rules, stages, recent).select("winner", "decided_by").first())


def test_claims_are_compared_by_comparable_authority_only(spark):
    old, new = ("jira", "2020-01-01", None), ("slack", "2021-01-01", None)
    assert decided_pair(spark, old, new, [("p", "jira", 5.0), ("p", "slack", 2.0)]) == ("left", "authority")
    assert decided_pair(spark, old, new, [("p", "jira", 2.0), ("p", "slack", 2.0)]) == ("right", "recency")
    assert decided_pair(spark, old, new, [("p", "jira", 2.0)]) == ("unresolved", "no_policy")  # the newer one doesn't win without a policy
    assert decided_pair(spark, old, new, [("q", "jira", 2.0), ("q", "slack", 1.0)]) == ("unresolved", "no_policy")
    assert decided_pair(spark, ("jira", None, None), new, [("p", "jira", 2.0), ("p", "slack", 2.0)]) == ("unresolved", "no_decisive_rule")


def test_tiers_of_adjudication(spark):
    stages, a, b = [("p", "proposed", 0), ("p", "in_force", 1)], ("jira", "2020-01-01", "in_force"), ("slack", "2021-01-01", "proposed")
    assert decided_pair(spark, a, b, [("p", "jira", 1.0), ("p", "slack", 2.0)], stages, []) == ("right", "authority")
    assert decided_pair(spark, a, b, [], stages, ["p"]) == ("left", "lifecycle")
    assert decided_pair(spark, a, ("slack", "2021-01-01", None), [], stages, ["p"]) == ("right", "recency")  # not grounded on both sides
    assert decided_pair(spark, a, b, [], [], ["p"]) == ("right", "recency") and decided_pair(spark, a, b, [], [], ["q"]) == ("unresolved", "no_policy")
    assert decided_pair(spark, a, ("slack", None, "in_force"), [], stages, ["p"]) == ("unresolved", "no_decisive_rule")


def test_claims_of_two_predicates_are_incomparable(spark):
    c = spark.createDataFrame([("s", "p", "v", "string", "a", "s", "q", "v", "string", "b"), ("s", "p", "v", "string", "a", "s", "p", "v", "number", "a"), ("s", "p", "v", "string", "a", "s", "p", "v", "string", "a")], "l_subject string, l_predicate string, l_value string, l_datatype string, l_source string, r_subject string, r_predicate string, r_value string, r_datatype string, r_source string").withColumns({f"{x}_{t}": F.lit(None).cast("timestamp") for x in "lr" for t in ("valid_from", "valid_to")})
    aligned = (F.col("l_subject") == F.col("r_subject")) & (F.col("l_predicate") == F.col("r_predicate"))
    assert [r[0] for r in c.select(claims.relation(aligned=aligned)).collect()] == ["incomparable", "contradiction", "equivalent"]


def test_a_supported_answer_leaves_out_the_claims_that_lost(spark):
    df = spark.createDataFrame([(True, True, 3, 0, 1), (True, True, 3, 1, 1)], "identified boolean, covered boolean, claims bigint, open_conflicts bigint, lost bigint")
    assert [(r["verdict"], r["answers"], r["reason"]) for r in claims.verdicts(df).collect()] == [("SUPPORTED", 2, "claim_supported"), ("DISPUTED", 0, "claims_disputed")]
    lost = spark.createDataFrame([("s", "a", "b", "left"), ("s", "c", "b", "left"), ("s", "a", "c", "unresolved")], "subject string, l_claim string, r_claim string, winner string")
    assert rows(claims.losers(lost, ["subject"])) == [("s", "b")]


@pytest.mark.parametrize("given,verdict", [((False, True, 1, 0), "UNKNOWN"), ((True, True, 1, 1), "DISPUTED"), ((True, False, 1, 0), "SUPPORTED"), ((True, True, 0, 0), "NOT_FOUND"), ((True, False, 0, 0), "UNKNOWN"), ((True, None, None, None), "UNKNOWN")])
def test_verdicts(spark, given, verdict):
    df = spark.createDataFrame([given], "identified boolean, covered boolean, claims bigint, open_conflicts bigint")
    assert claims.verdicts(df).first()["verdict"] == verdict


EDGES = [("A", "1", "2"), ("B", "2", "3"), ("A", "2", "4"), ("A", "4", "1"), ("B", "4", "5")]


def test_paths(spark):
    e, start = spark.createDataFrame(EDGES, "type string, src string, dst string"), spark.createDataFrame([("1",)], "id string")
    assert rows(graph.follow(start, e, ["A", "B"])) == [("1", "3")]
    assert rows(graph.distances(start, e, ["A", "B"], 9)) == [("1", "1", 0), ("1", "2", 1), ("1", "3", 2), ("1", "4", 2), ("1", "5", 3)]
    assert rows(graph.distances(start, e, ["A"], 1)) == [("1", "1", 0), ("1", "2", 1)]
    assert rows(graph.dangling(spark.createDataFrame([(x,) for x in "1234"], "id string"), e)) == [("B", "4", "5")]


def test_upserts_and_fingerprints(spark):
    e = spark.createDataFrame(EDGES, "type string, src string, dst string")
    new = spark.createDataFrame([("A", "1", "9"), ("B", "7", "8")], "type string, src string, dst string")
    once = graph.upsert_exclusive(e, new, "A")
    assert ("A", "1", "9") in rows(once) and ("A", "1", "2") not in rows(once) and rows(graph.upsert_exclusive(once, new, "A")) == rows(once)
    f = lambda x: rows(graph.fingerprint(x, ["type", "src", "dst"]))
    assert f(e) == f(e.unionByName(e).repartition(3, "dst")) != f(once)


def test_ranking_by_terms(spark):
    docs = spark.createDataFrame([(1, "alpha", "beta beta", "s"), (2, "beta", "alpha", "s"), (3, None, "gamma alpha alpha alpha alpha", "t"), (4, "zeta", None, "t")], "d int, title string, body string, src string")
    q = spark.createDataFrame([("q", "alpha"), ("none", "of the")], "q string, question string")
    hits = retrieval.term_hits(q, "q", "question", docs, "d", "title", "body")
    assert rows(hits) == [("q", 1, 5), ("q", 2, 1), ("q", 3, 3)]
    d = retrieval.diverse(hits.join(docs.select("d", "src"), "d"), "q", "d", "src", "score", 3)
    assert [r["d"] for r in d.orderBy("place").collect()] == [1, 3, 2]
    top = retrieval.bm25(q, "q", retrieval.query_terms(F.col("question")), docs, "d", ["title", "body"], 2)
    assert [r["d"] for r in top.orderBy("place").collect()] == [3, 2]


def test_relational_division(spark):
    sets = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("h", None)], "g string, m int")
    found = spark.createDataFrame([("q", 1), ("q", 2), ("q", 2), ("r", 1), ("r", 3)], "q string, m int")
    assert rows(retrieval.contained(sets, "g", "m", found, "q")) == [("q", "g"), ("r", "h")]


def test_spans_of_text(spark):
    df = spark.createDataFrame([(1, "a b\n\nc\nd not a"), (2, None)], "d int, t string")
    assert rows(retrieval.segments(df, "d", "t", (1, 2))) == [(1, 0, 1, "a b"), (1, 0, 2, "a b\nc"), (1, 1, 1, "c"), (1, 1, 2, "c\nd not a"), (1, 2, 1, "d not a")]
    terms = F.array(F.lit("a"), F.lit("b"))
    got = df.select(retrieval.excerpt(F.col("t"), terms, 7).alias("e"), retrieval.contrast_line(F.col("t"), terms).alias("c")).collect()
    assert [tuple(r) for r in got] == [("a b", "d not a"), (None, None)]


def test_diverse_choice_of_spans(spark):
    df = spark.createDataFrame([("q", "one two three", 3.0), ("q", "one two three four", 2.0), ("q", "five six", 1.0), ("q", "x" * 99, 9.0), ("r", None, 1.0)], "q string, s string, w double")
    assert [r["s"] for r in contexts.diverse_spans(df, "q", "s", "w", 2, 40).orderBy("place").collect()] == ["one two three", "five six"]


def test_replacements_of_equal_length(spark):
    c = spark.createDataFrame([("q", 1, True, 5), ("q", 2, True, 5), ("q", 3, False, 5)], "q string, d int, gone boolean, n int")
    pool = spark.createDataFrame([("q", 3, 5), ("q", 7, 5), ("q", 8, 6)], "q string, d int, n int")
    assert rows(contexts.replace_removed(c, "q", "d", "gone", "n", pool)) == [("q", 1, 7), ("q", 2, None)]


def test_wording_and_audit(spark):
    df = spark.createDataFrame([(1, "Final, approved."), (2, "A draft\npassword: hunter2"), (3, "  a  b\tc d")], "d int, t string")
    assert [r[0] for r in df.select(contexts.precedence(F.col("t"))).collect()] == [3, -3, 0]
    assert rows(contexts.scan(df, "d", "t")) == [(2, 2, "password")]
    assert df.where("d = 3").select(contexts.word_prefix(F.col("t"), 3)).first()[0] == "  a  b\tc"


def test_answers_cite_what_they_were_given(spark):
    df = spark.createDataFrame([([1], [1, 2], "SUPPORTED", "yes"), ([3], [1], "SUPPORTED", "yes"), ([], [1], "UNKNOWN", "well"), (None, None, "SUPPORTED", None), (None, None, "UNKNOWN", None)], "c array<int>, s array<int>, v string, a string")
    assert [r["fault"] for r in contexts.answer_checks(df, "c", "s", "v", "a").collect()] == [None, "cites_what_it_lacks", "answers_an_abstention", "says_nothing", None]


def test_pair_quality_and_clusters(spark):
    p = spark.createDataFrame([("s", True, True), ("s", False, True), ("s", True, False), ("s", False, False), ("t", False, False), ("t", None, True)], "s string, t boolean, g boolean")
    assert rows(quality.pair_quality(p, "t", "g", ["s"])) == [("s", 1, 1, 1, 1, 0.5, 0.5, 0.5), ("t", 0, 0, 0, 1, None, None, None)]
    c = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "b"), (4, "y", "b"), (5, None, "b")], "i int, c string, t string")
    cells = quality.cell_counts(c, "i", "c", "t")
    got = quality.b_cubed(cells, "c", "t").first()
    assert (got["items"], round(got["precision"], 6), round(got["recall"], 6)) == (4, round((2 / 3 + 2 / 3 + 1 / 3 + 1) / 4, 6), 0.75)
    assert rows(quality.purity(cells, "c")) == [(2, 4, 0.75)]


def test_confusions_overlaps_and_equality(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "z")], "e string, g string")
    assert rows(quality.confusion(df, "e", "g", ["a", "b"])) == [("a", 1, 1), ("b", 0, 0)]
    s = spark.createDataFrame([([1, 1, 2], [2, 3]), (None, [1]), ([1], None)], "e array<int>, a array<int>")
    assert [tuple(r) for r in quality.set_overlap(s, "e", "a").select("hits", "misses", "extras").collect()] == [(1, 1, 1), (0, 0, 1), (0, 1, 0)]
    assert rows(quality.same_rows(df, df.unionByName(df.limit(1)))) == [(0, 1)]
    x = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "x double")
    assert x.select(quality.nearest_rank("x", 95), quality.nearest_rank("x", 50)).first()[:2] == (19.0, 10.0)


def test_alignment(spark):
    seen = spark.createDataFrame([("jira", "t", "OwnerTeam"), ("slack", "t", "OwnerTeam"), ("slack", "t", "odd")], "system string, object_type string, field string")
    hints = spark.createDataFrame([("jira", "t", "owner_team", "ASSIGNED"), (None, None, "owner_team", "OWNED")], "system string, object_type string, field string, target string")
    terms = alignment.source_terms(seen, hints)
    assert [r["target"] for r in terms.orderBy("system", "field").collect()] == ["ASSIGNED", "OWNED", "UNMAPPED"]
    onto = spark.createDataFrame([("OWNED", "s", "t"), ("ASSIGNED", "s", "t")], "target string, domain string, range string")
    rules = spark.createDataFrame([("owner_team", "OWNED", "s", "t")], "surface string, target string, domain string, range string")
    assert [(r["status"], r["constraint"]) for r in alignment.alignment_decisions(terms, onto, rules).orderBy("system", "field").collect()] == [("rejected", "target_mismatch"), ("accepted", None), ("pending", None)]


def test_coverage_gaps(spark):
    need = spark.createDataFrame([("a", "t", "p"), ("b", "t", "p"), ("c", "t", "p"), ("d", "t", "p"), ("e", "t", "p")], "system string, object_type string, predicate string")
    have = spark.createDataFrame([("a", "t", "complete", ["p"]), ("b", "t", "failed", []), ("c", "t", "partial", ["p"]), ("d", "t", "complete", ["q"])], "system string, object_type string, status string, predicates array<string>")
    assert rows(alignment.coverage_gaps(need, have).select("system", "gap")) == [("a", None), ("b", "ingestion_failed"), ("c", "ingestion_incomplete"), ("d", "predicate_not_examined"), ("e", "slice_missing")]


def test_staged_tables_can_be_cleared(spark):
    import os

    from tessella import staging

    one = staging.Staged(spark.range(5).toDF("x"), "t")
    path = one.path.removeprefix("file://")
    assert one.df.count() == 5 and os.path.isdir(path)
    staging.clear()
    assert not os.path.exists(path) and not staging._written


def test_what_was_shuffled_for_a_staged_table_is_removed(spark):
    from tessella import staging

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, conf = files(), spark.conf.get(staging._CLEANUP)
    df = staging.stage(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert not files() - before and spark.conf.get(staging._CLEANUP) == conf and df.count() == 7
    staging.clear()


def test_lines_come_from_all_ranked_documents(spark, monkeypatch):
    from tessella.plans import contexts as plan
    from tessella.plans import search

    same = "one two three"
    texts = [same, same, f"{same}\n \r\n{same} ", "x" * 901, "four five", "a\nb\nc\nd", "late"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hits = [("p", i, 9.0 - i, i + 1) for i in range(5)] + [("q", 5, 2.0, 1), ("q", 6, 1.0, 2), ("r", 6, 3.0, 1), ("r", 4, 3.0, 2), ("r", 5, 1.0, 3)]
    monkeypatch.setattr(search, "title_hits", lambda s, d: spark.createDataFrame(hits, "question_id string, doc_id bigint, score double, place int"))
    monkeypatch.setattr(plan, "table", lambda s, d, name: docs)
    assert rows(plan.diverse_segments(spark, "").select("question_id", "place", "segment")) == [("p", 1, same), ("p", 2, "four five"), ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("r", 1, "four five"), ("r", 2, "late"), ("r", 3, "a")]


def test_lines_beyond_a_document_s_first_ones_count(spark, monkeypatch):
    """Three lines of the first ones are final only if all lines that were left out come after them."""
    from tessella.plans import contexts as plan
    from tessella.plans import search

    alike = [f"m one two three four five {i:02}" for i in range(plan._HEAD + 4)]
    texts = ["\n".join([*alike, "n", "o", "p"]), "a\nz\nzz", "\n".join([*alike[::-1], "b"]), "k", "\n".join(f"c{i:02}" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hits = [("p", 0, 5.0), ("q", 0, 5.0), ("q", 1, 5.0), ("r", 2, 5.0), ("r", 3, 4.0), ("s", 4, 5.0), ("s", 3, 1.0)]
    monkeypatch.setattr(search, "title_hits", lambda s, d: spark.createDataFrame(hits, "question_id string, doc_id bigint, score double"))
    monkeypatch.setattr(plan, "table", lambda s, d, name: docs)
    want = {"p": [alike[0], "n", "o"], "q": ["a", alike[0], "n"], "r": ["b", alike[0], "k"], "s": ["c00", "c01", "c02"]}
    assert rows(plan.diverse_segments(spark, "").select("question_id", "place", "segment")) == [(q, i + 1, x) for q, own in want.items() for i, x in enumerate(own)]


def test_no_line_is_read_once_a_case_has_its_spans(spark):
    df = spark.createDataFrame([("c", f"w{i:03}", None if i == 0 else float("nan") if i == 1 else 1.0) for i in range(50)], "q string, s string, w double")
    assert [r["s"] for r in contexts.diverse_spans(df, "q", "s", "w", 49, 900).orderBy("place").collect()] == [f"w{i:03}" for i in [*range(2, 50), 1]]
    assert "FlatMapGroups" not in contexts.diverse_spans(df, "q", "s", "w", 3, 900)._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark, n=700):
    import random

    rng = random.Random(3)
    word = lambda: rng.choices("abcdefgh", [40, 30, 20, 10, 5, 3, 2, 1])[0] * 2
    docs = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, " ".join(word() for _ in range(3)), " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(n)] + [(5, "s2", "aa", "bb bb")], "d bigint, src string, title string, body string")
    return spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(4))) for i in range(40)] + [("none", "zz"), ("void", None)], "q string, question string"), docs


def test_best_hits_are_those_of_all_hits(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCUMENTS", 90)
    q, docs = _texts(spark)
    plain = retrieval.best_hits(q, "q", "question", docs, "d", "title", "body", 5)
    want = rows(retrieval.ranked(retrieval.term_hits(q, "q", "question", docs, "d", "title", "body"), "q", "d", "score", 5))
    assert rows(retrieval.ranked(plain, "q", "d", "score", 5)) == want and len(want) == 200
    assert plain.groupBy("q").count().agg(F.max("count")).first()[0] <= 5 * 8  # of each of 8 chunks 5, not all that share a word


def test_best_hits_of_every_source(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCUMENTS", 90)
    q, docs = _texts(spark)
    every = retrieval.term_hits(q, "q", "question", docs, "d", "title", "body", ("src",))
    best = retrieval.best_hits(q, "q", "question", docs, "d", "title", "body", 5, ("src",))
    assert rows(retrieval.diverse(best, "q", "d", "src", "score", 5)) == rows(retrieval.diverse(every, "q", "d", "src", "score", 5))
    assert best.count() < every.count() / 5


def test_bm25_equals_sums_over_all_documents(spark, monkeypatch):
    import math
    import re
    from collections import Counter, defaultdict

    monkeypatch.setattr(retrieval, "DOCUMENTS", 90)
    q, docs = _texts(spark)
    every = [(r["d"], re.findall("[a-z0-9]+", f"{r['title']} {r['body']}".lower())) for r in docs.collect()]
    n, mean, texts = len(every), sum(len(w) for _, w in every) / len(every), defaultdict(list)
    for d, w in every:
        texts[d, len(w)] += w  # rows of one id and length count as one text, as in the SQL
    df = Counter(t for w in texts.values() for t in set(w))
    want = []
    for r in q.where("question IS NOT NULL").collect():
        score = defaultdict(float)
        for (d, length), w in texts.items():
            for t in set(r["question"].split()) & set(w):
                tf = w.count(t)
                score[d] += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
        want += [(r["q"], d, round(s, 6), i + 1) for i, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5])]
    got = retrieval.bm25(q, "q", retrieval.query_terms(F.col("question")), docs, "d", ["title", "body"], 5)
    assert rows(got) == sorted(want, key=repr) and "FlatMapCoGroups" in got._jdf.queryExecution().optimizedPlan().toString()


def test_segments_count_each_text_once(spark, monkeypatch):
    from tessella.plans import search

    docs = spark.createDataFrame([(1, "x", "a\nbb"), (1, "x", "ccc"), (None, "y", "d\n\ne"), (2, "y", None), (3, None, " ")], "doc_id bigint, source_type string, text string")
    monkeypatch.setattr(search, "table", lambda s, d, name: docs)
    assert rows(search.text_segments(spark, "")) == [("x", 1, 3, 6), ("x", 2, 1, 4), ("y", 1, 2, 2), ("y", 2, 1, 3)]
    assert "Join" not in search.text_segments(spark, "")._jdf.queryExecution().optimizedPlan().toString()


def test_citations_are_looked_up_one_by_one(spark, monkeypatch):
    from tessella.plans import contexts as plan

    runs = [(1, "a", "SUPPORTED", "done", [1, 2, 2, None]), (2, "a", "SUPPORTED", "done", [1, 3]), (3, "b", "SUPPORTED", " ", None), (4, None, "UNKNOWN", "done", [1]), (5, "c", "UNKNOWN", "done", [None]), (None, "a", "DISPUTED", "done", [])]
    tables = {"causal_score_row": spark.createDataFrame([(*r, None, 1.0) for r in runs], "row_id bigint, case_id string, verdict string, status string, evidence_document_ids array<bigint>, loaded_at timestamp, latency_ms double"), "retrieval_candidate": spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 9), (None, 1)], "question_id string, doc_id bigint")}
    monkeypatch.setattr(plan, "table", lambda s, d, name: tables[name])
    got = plan.answer_faults(spark, "")
    assert rows(got) == sorted([("SUPPORTED", None, 1), ("SUPPORTED", "cites_what_it_lacks", 1), ("SUPPORTED", "says_nothing", 1), ("UNKNOWN", "cites_what_it_lacks", 1), ("UNKNOWN", None, 1), ("DISPUTED", None, 1)], key=repr)
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_looked_up_one_by_one(spark, monkeypatch):
    from tessella.plans import measures as plan

    runs = [(1, "a", "X-1", [1, 2, 2, None]), (2, "a", "x_1", [1, 7]), (3, "b", "x_1", None), (4, "none", "x_1", [1]), (5, "b", None, [9])]
    tables = {"causal_score_row": spark.createDataFrame([(*r, None, 1.0) for r in runs], "row_id bigint, case_id string, arm_id string, evidence_document_ids array<bigint>, loaded_at timestamp, latency_ms double"), "retrieval_candidate": spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.4), ("a", 2, 0.5), ("a", 7, 0.3), ("b", 9, 0.8), ("b", 8, float("nan"))], "question_id string, doc_id bigint, score double")}
    monkeypatch.setattr(plan, "table", lambda s, d, name: tables[name])
    got = plan.case_metrics(spark, "")
    assert rows(got.select("arm", "runs", "recall", "precision", "with_extras")) == [("x_1", 3, 0.6, 0.75, 1), (None, 1, 1.0, 1.0, 0)]
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()
