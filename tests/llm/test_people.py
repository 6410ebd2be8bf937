"""Names, clustering and linkage."""

import random

import numpy as np
import pytest

from tessella.llm import clustering, linkage, names, people


def test_names_are_read_in_any_order():
    assert people.name_parts("Łodandnes, Fiona M.") == (["fiona", "lodandnes"], [])
    assert people.name_parts('Dr. Małgorzata "Gosia" Treaeau (ext), PhD') == (["malgorzata", "treaeau"], ["gosia"])
    assert people.name_parts("K Pelsvkaya, MBA") == (["k", "pelsvkaya"], [])
    assert people.name_parts(None) == ([], []) and people.name_parts("...") == ([], [])


def test_who_is_the_same_person():
    first = people.FirstNames({"daniel", "daniela", "stephen", "steve", "ida"}, {("ida", "idchen"), ("stephen", "steve")}, {("paul", "paula")})
    same = lambda a, b: people.same_person(people.name_parts(a), people.name_parts(b), first) > 0
    assert same("Steve Kesavwick", "KESAVWICK, Stephen") and same("S. Kesavwick", "Stephen Kesawvick") and same("Idchen Ostby", "Ostby Ida")
    assert not same("Daniel Duladotter", "Daniela Duladotter") and not same("Ida Ostby", "Ida Gusnova") and not same("Ida", "Ostby")
    assert not same("Paul Ostby", "Paula Ostby") and same("Paula Ostby", "Paulla Ostby")


@pytest.mark.parametrize("typed", ["The Casema Energy Retail & Co. KG", "CasemaEnergyRetail", "Energy Retail Casema (HQ)", "CASEMA ENREGY RETAIL", "Casema Enrgy Retl u. Co. KG", "CER", "C.E.R. / Procurement"])
def test_firms_however_typed(typed):
    assert people.firm_cost(people.firm_parts(typed)[0], people.firm_parts("Casema Energy Retail & Co. KG")[0]) <= names.FIRM_COST


@pytest.mark.parametrize("typed", ["Casema Cold Storage", "Halela Energy Retail BV", "n/a", ""])
def test_other_firms(typed):
    assert people.firm_cost(people.firm_parts(typed)[0], people.firm_parts("Casema Energy Retail & Co. KG")[0]) > names.FIRM_COST


def test_distance_is_that_of_slips():
    assert people.distance("ab", "ba", 2) == 1 and people.distance("kitten", "sitting", 3) == 3 and people.distance("a", "abcdef", 2) > 2


def linked(edges, threshold):
    """Merging the nearest pair of clusters again and again."""
    sim = {frozenset(e[:2]): e[2] for e in edges}
    clusters = [frozenset([x]) for x in {y for e in edges for y in e[:2]}]
    average = lambda a, b: sum(sim.get(frozenset((x, y)), 0.0) for x in a for y in b) / (len(a) * len(b))
    while True:
        best = max(((average(a, b), a, b) for i, a in enumerate(clusters) for b in clusters[i + 1 :]), key=lambda x: x[0], default=(0, 0, 0))
        if best[0] < threshold:
            return {min(c): c for c in clusters}
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] | best[2]]


def test_average_linkage_is_that_of_one_merge_at_a_time(spark):
    r = random.Random(9)
    for _ in range(3):
        edges = [(f"{i:02}", f"{j:02}", r.random()) for i in range(22) for j in range(i + 1, 22) if r.random() < 0.25]
        got = {}
        for x in clustering.average_linkage(spark.createDataFrame(edges, "a string, b string, similarity double"), 0.3).collect():
            got.setdefault(x["cluster"], set()).add(x["node"])
        assert {k: frozenset(v) for k, v in got.items()} == linked(edges, 0.3)
    assert clustering.average_linkage(spark.createDataFrame([], "a string, b string, similarity double"), 0.3).count() == 0


@pytest.mark.parametrize("hot", [2048, 7])
def test_the_cosine_join_is_that_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(names, "HOT", hot)
    r = random.Random(10)
    words = ["".join(r.choices("abcdefgh", k=7)) for _ in range(60)]
    texts = sorted({f"{r.choice(words)} {r.choice(words)}" for _ in range(200)})
    left, right = ([(str(i % 2), t) for i, t in enumerate(x)] for x in (texts, texts[:50]))
    frame = lambda x: spark.createDataFrame(x, "block string, text string")
    weights = spark.sparkContext.broadcast(names.gram_weights(frame(left), "text"))
    cosine = names.Cosines(weights.value)
    want = {(p, a, b) for p, a in left for q, b in left if p == q and a < b and cosine(a, b) >= 0.4}
    got = [(x["block"], min(x["a"], x["b"]), max(x["a"], x["b"])) for x in names.near_texts(frame(left), None, weights, 0.4).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want
    want = {(p, a, b) for p, a in left for q, b in right if p == q and cosine(a, b) >= 0.4}
    assert {(x["block"], x["a"], x["b"]) for x in names.near_texts(frame(left), frame(right), weights, 0.4).collect()} == want


@pytest.mark.parametrize("hot", [2048, 7])
def test_names_are_compared_where_they_meet(spark, monkeypatch, hot):
    """Each pair of one person or one family name that reaches the cosine comes out once, with all of its nodes."""
    monkeypatch.setattr(names, "HOT", hot)
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(40)]
    slip = lambda w: w if len(w) < 3 else w[: (i := r.randrange(len(w)))] + r.choice(["", w[i] + "x", w[i + 1 : i + 2] + w[i], "x"]) + w[i + 1 + (r.random() < 0.3) :]
    texts = sorted({f"{r.choice([f, slip(f)])} {r.choice([g, slip(g), slip(slip(g))])}".strip() for f, g in ((r.choice(words), r.choice(words)) for _ in range(300))} | {"alone", "x"})
    nodes = [("b", t, t, None) for t in texts] + [("b", t, f"{t}|tim", "a \x1e\"role") for t in texts[::9]] + [("c", t, t, "") for t in texts[::3]]
    df = spark.createDataFrame(nodes, "block string, text string, spelled string, hint string")
    weights = spark.sparkContext.broadcast(names.gram_weights(df, "text"))
    cosine, learned = names.Cosines(weights.value), people.FirstNames(set(), {(a, b) for a in words[::2] for b in words[1::2]})
    apart = lambda t: (t.split(" "), [])
    kin = lambda a, b: len(a.split()) == len(b.split()) == 2 and (a.split()[1] == b.split()[1] or people.same_person(apart(a), apart(b), learned) > 0)
    near = {(p, x, y, g, h) for p, a, x, g in nodes for q, b, y, h in nodes if p == q and a < b and cosine(a, b) >= 0.35}
    text = {x: t for _, t, x, _ in nodes}
    got = [(x["block"], x["a_spelled"], x["b_spelled"], x["a_hint"], x["b_hint"]) for x in names.near_spellings(df, weights, 0.35).collect()]
    want = {x for x in near if kin(text[x[1]], text[x[2]])}
    assert len(want) > 100 and len(got) == len(set(got)) and want <= set(got) <= near


def test_no_pair_is_shuffled_before_it_reaches_the_cosine(spark):
    """Names of one first name meet, and end in their task: what is shuffled follows the names."""
    df = spark.createDataFrame([("b", f"joost {c}{d}{e}vorhn", f"joost {c}{d}{e}vorhn", None) for c in "bdfgk" for d in "aeiou" for e in "lmnp"], "block string, text string, spelled string, hint string")
    weights = spark.sparkContext.broadcast(names.gram_weights(df, "text"))
    plan = names.near_spellings(df, weights, 0.35)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan


def test_forms_of_first_names_are_learned_and_relatives_told_apart(spark):
    people_ = [(f"fam{i}", f, "role" + str(i)) for i in range(4) for f in ("Timothy", "Tim")] + [(f"kin{i}", f, f"{f}s role") for i in range(4) for f in ("Marcus", "Marcos")] + [(f"one{i}", f, "r") for i in range(40) for f in ("Timothy", "Marcus", "Marcos")]
    df = spark.createDataFrame([(f"{i:03}", f"{f} {n}inger", "x", role) for i, (n, f, role) in enumerate(people_)], "k string, n string, o string, r string")
    records, nodes, pairs = names.near_names(df, "k", "n", "o", hint="r")
    found = names.learn_first_names(nodes, names._hinted(pairs.where("a_spelled NOT LIKE '% one%'")))
    assert ("tim", "timothy") in found.short and ("marcos", "marcus") in found.apart and found.same("marcos", "marcus") == 0 < found.same("tim", "timothy")


def test_linking_names_in_blocks(spark):
    data = [("1", "Fiona Łodandnes", "x"), ("2", "Lodandnes, Fiona", "x"), ("3", "FIONA LODANNDES", "x"), ("4", "Fiona Łodandnes", "y"), ("5", None, "x"), ("6", "", "x"), ("7", "Fiona Łodandnes", None), (None, "Fiona Łodandnes", "x"), ("8", "Fiona Łodandnes", "x"), ("8", "Fiona Łodandnes", "x"), ("9", "Ida Berg " * 3000, "x")]
    df = spark.createDataFrame(data, "k string, n string, o string").selectExpr("*", "'s' AS spelled", "'b' AS block", "1 AS id")
    clusters = {}
    for r in names.link_names(df, "k", "n", "o").collect():
        clusters.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, clusters.values())) == [["1", "2", "3", "8"], ["4"], ["9"]]
    assert names.link_names(df.where("false"), "k", "n", "o").count() == 0


def test_linking_firms(spark):
    listed = spark.createDataFrame([("o1", "Casema Energy Retail & Co. KG"), ("o2", "Casuvo Data Centers AB"), ("o3", "Corovo Data Centers AB"), ("o4", None)], "org string, firm string")
    typed = ["CasemaEnergyRetail", "CDC", "n/a", "", None, "Casuvo Data Cntrs", "Casema Cold Storage", "The Casema Cold Storage GmbH", "Casema Energy Retail & Co. KG"]
    got = names.link_firms(spark.createDataFrame([(t,) for t in typed], "c string"), "c", listed, "org", "firm")
    by = {r["typed"]: (r["key"], r["firm"]) for r in got.collect()}
    assert {t: k for t, (k, _) in by.items()} == {"Casema Energy Retail & Co. KG": "o1", "CasemaEnergyRetail": "o1", "Casuvo Data Cntrs": "o2", "CDC": None, "Casema Cold Storage": None, "The Casema Cold Storage GmbH": None}
    assert by["Casema Cold Storage"][1] == by["The Casema Cold Storage GmbH"][1] != by["CDC"][1]
    assert names.link_firms(spark.createDataFrame([], "c string"), "c", listed, "org", "firm").count() == 0


REVIEW = "source_object_id string, source_system string, source_native_id string, source_object_type string, employee_id string, external_identifiers array<struct<namespace:string,value:string>>, name string, role string, organization string, location string, payload_digest string, observed_at timestamp"


def population(r, n):
    """True people, and records of them in three systems with slips and gaps; truth by id."""
    firsts, lasts = ["Ida", "Bruno", "Clara", "Dario", "Elena", "Farid", "Greta", "Hugo"], ["".join(r.choices("bdfgklmnprstv", k=1)[0] + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    orgs, places, roles = ["Edge Delivery", "Hardware Lab", "Search Quality", "Field Operations"], ["Corvale", "Marisco", "Quellen", "Zimnica", "Ardholt"], ["QA Engineer", "Data Analyst", "Legal Counsel", "Sales Director"]
    rows, truth = [], {}
    for p in range(n):
        first, last, org, place, role = r.choice(firsts), r.choice(lasts).title() + r.choice(["son", "berg", "ova", "ic"]), r.choice(orgs), r.choice(places), r.choice(roles)
        for system in ("herb", "slack", "jira"):
            name = f"{first} {last}"
            if system != "herb":
                if r.random() < 0.3:
                    continue
                if r.random() < 0.3:
                    i = r.randrange(1, len(last) - 1)
                    name = f"{first} {last[:i]}{last[i + 1 :]}"
                if r.random() < 0.2:
                    name = f"{name.split()[1]}, {first}"
            gap = lambda x, s=system: None if s != "herb" and r.random() < 0.2 else x
            key = f"{system}{p:04}"
            truth[key] = p
            rows.append((key, system, key, "account", None, [("slack:handle", f"{first}.{last}".lower())] if system == "slack" else None, name, gap(role), gap(org), gap(place), "d", None))
    return rows, truth


def test_linkage_on_people_of_known_truth(spark):
    rows, truth = population(random.Random(11), 400)
    extra = [(None, "jira", None, None, None, None, "Ida Berg", None, None, None, None, None), ("n1", None, None, None, None, [], "Ida Berg", "", "", "", None, None), ("n2", "jira", None, None, None, [(None, None)], None, None, None, None, None, None), ("n3", "jira", None, None, None, [("jira:ext", "x")], "  ", None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:20] + extra, REVIEW).selectExpr("*", "'a' AS a", "'x' AS node", "1 AS confidence")
    got = {(r["left"], r["right"]): r["confidence"] for r in linkage.link_records(df).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    right = len(want & set(got))
    assert right / len(got) > 0.95 and right / len(want) > 0.9
    assert all(linkage.LINK <= c <= 1 for c in got.values())


def test_linkage_of_nothing(spark):
    assert linkage.link_records(spark.createDataFrame([], REVIEW)).count() == 0


def test_the_label_model_tells_good_votes_from_bad_ones():
    r = np.random.default_rng(12)
    truth = r.random(20000) < 0.4
    votes = []
    for size, accuracy in zip(linkage.VOTES.values(), (0.9, 0.6, 0.95, 0.9, 0.8, 0.99, 0.5), strict=True):
        right = r.random(len(truth)) < accuracy
        said = np.where(truth == right, size - 1, 1)
        votes.append(np.where(r.random(len(truth)) < 0.25, 0, said))
    patterns, back, counts = np.unique(np.stack(votes, 1), axis=0, return_inverse=True, return_counts=True)
    # a tenth of the names of one person differ here, more than the default allows for
    found = linkage.LabelModel(patterns, counts.astype(float), nameless=0.1).posterior[back.ravel()]
    assert ((found > 0.5) == truth).mean() > 0.97
