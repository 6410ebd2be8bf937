"""Matching entities across sources without keys, by a label model.

Several heuristic functions vote on each candidate pair; a generative model learns, without labels, how often each
vote is given to pairs that are one person and to pairs that aren't, and which votes hang together (a tree of dependencies
in either class), and gives every pair its posterior. No rule keeps a candidate from the model. Votes come in few combinations, so
the model is fitted on counts of combinations over all pairs, however many there are. What a pair's surely linked third records say is a
vote too: the model is fitted again with it, and its posterior is every pair's confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.names import HOT, _unspelled, learn_first_names, plain, relatives, spelled
from tessella.llm.people import FirstNames, distance, firm_cost, fold, same_person, shortened
from tessella.staging import stage

#: The votes and how many answers each has; 0 is always an abstention.
VOTES = {"name": 5, "alone": 3, "org": 3, "place": 3, "role": 3, "phone": 4, "handle": 3}
#: The vote of third records, in the second fit: whether both are surely linked to one, or one of them to another record of the other's system alone.
THIRD = {"third": 3}
#: Posterior from which a pair is linked, and from which it is sure enough to speak for others.
LINK, SURE = 0.5, 0.9
#: A telephone extension is a switchboard's if this share of all records has it.
SHARED_PHONE = 1 / 1000
ROUNDS = 60
#: Pairs of one person whose names have nothing to do with each other, at most.
NAMELESS = 0.01

#: How each answer counts in the first guess, from which learning starts (log odds); abstentions count nothing.
_GUESS = {"name": (0, -4.0, -0.5, 0.7, 1.5), "alone": (0, 1.0, -0.7), "org": (0, -1.5, 1.7), "place": (0, -1.5, 1.7), "role": (0, -1.2, 1.4), "phone": (0, -3.0, 0.2, 4.0), "handle": (0, -0.7, 0.7), "third": (0, -1.0, 2.0)}
_PRIOR = -1.0

_PHONES = ("phone", "ext")
_HANDLES = ("address", "login", "handle")


def _words(text: str | None) -> str:
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(text))
    return " ".join(re.findall(r"[a-z0-9]+", re.sub(r"\.(?=[a-z])", "", text)))


def _place(text: str | None) -> str:
    return re.sub(r"[^a-z]", "", re.sub(r"\b(?:office|remote|hq|site)\b", "", _words(text)))


@lru_cache(maxsize=100_000)
def _same_words(a: str, b: str) -> int:
    """0 where one is missing, 1 where they differ, 2 where they are the same, shortened or with slips."""
    if not a or not b:
        return 0
    if a == b:
        return 2
    x, y = a.split(), b.split()
    if len(x) == len(y) and all(p == q or (len(min(p, q, key=len)) == 2 and (shortened(p + "_", q) or (p[0] == q[0] and (set(p) <= set(q) or set(q) <= set(p))))) or firm_cost([p], [q]) <= 2 for p, q in zip(x, y, strict=True)):
        return 2
    initials = lambda w: "".join(p[0] for p in w)
    if len(x) > 2 and initials(x) in y or len(y) > 2 and initials(y) in x:
        return 2
    return 2 if min(firm_cost(x, y), firm_cost(y, x)) <= 2.5 else 1


@lru_cache(maxsize=100_000)
def _same_place(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return 2 if distance(a, b, 2) <= 2 else 1


def _names_handle(handles: list[str], words: list[str]) -> int:
    """Whether some handle is made of the name: its family name's beginning and its first name's, or initial."""
    if not handles or len(words) < 2:
        return 0
    for h in handles:
        for first, last in ((words[0], words[-1]), (words[-1], words[0])):
            rest = h.replace(last[:4], "", 1)
            if last[:4] in h and (rest.startswith(first[:1]) or first[:3] in h):
                return 2
            if first in h and last[:3] in h:
                return 2
    return 1


def _variants(word: str) -> set[str]:
    """A word and what it is with one letter left out: two words within one slip share one."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= 4 else set())


def records(people: DataFrame) -> DataFrame:
    """One row an object with its folded attributes: id, system, spelled, org, place, role, phones, handles.

    Of rows that repeat an object the one observed last counts. Objects without an id, system or name are left out.
    """
    order = [F.col("observed_at").desc_nulls_last(), F.col("payload_digest").asc()]
    latest = people.withColumn("__k", F.row_number().over(Window.partitionBy("source_object_id").orderBy(*order))).where("__k = 1")
    ids = F.to_json(F.filter("external_identifiers", lambda x: x["namespace"].isNotNull() & x["value"].isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            phones, handles = [], []
            for x in b["ids"]:
                given = pd.io.json.ujson_loads(x) if x else []
                kind = lambda g, kinds: g["namespace"].rpartition(":")[2].endswith(kinds)
                digits = {re.sub(r"\D", "", g["value"])[-4:] for g in given if kind(g, _PHONES)}
                phones.append(" ".join(sorted(d for d in digits if len(d) == 4)))
                found = {re.sub(r"[^a-z]", "", fold(g["value"].partition("@")[0])) for g in given if kind(g, _HANDLES)}
                handles.append(" ".join(sorted(h for h in found if h)))
            out = pd.DataFrame({"id": b["source_object_id"], "system": b["source_system"], "spelled": [spelled(x) for x in b["name"]], "org": [_words(x) for x in b["organization"]], "place": [_place(x) for x in b["location"]], "role": [_words(x) for x in b["role"]], "phones": phones, "handles": handles})
            yield out[out["spelled"].str.contains("[a-z]", regex=True)]

    have = F.col("source_object_id").isNotNull() & F.col("source_system").isNotNull() & F.col("name").isNotNull()
    kept = latest.where(have).select("source_object_id", "source_system", "name", "organization", "location", "role", ids.alias("ids"))
    return kept.mapInPandas(run, "id string, system string, spelled string, org string, place string, role string, phones string, handles string")


def _orders(words: list[str], common: set[str]) -> list[tuple[str, str]]:
    """First and family name; both ways where the first word isn't known as a first name."""
    first, family = words[0], words[-1]
    if first in common:
        return [(first, family)]
    return [(family, first)] if family in common else [(first, family), (family, first)]


def candidates(nodes: DataFrame, first_names) -> DataFrame:
    """Pairs of nodes of different systems whose names are near: a, b (a < b).

    They meet at a family name with at most one letter left out together with an initial the first name or one of its short forms
    has, or at a first name with an organisation or place and the family name's initial.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: FirstNames = first_names.value
        other: dict[str, set[str]] = {}
        for x, y in names.short:
            other.setdefault(x, set()).add(y)
        for b in batches:
            rows, keys = [], []
            for i, (text, org, place) in enumerate(zip(b["spelled"], b["org"], b["place"], strict=True)):
                words, aside = _unspelled(text)
                if len(words) < 2:
                    found = {f"n|{words[0]}"}
                else:
                    found = set()
                    for first, family in _orders(words, names.common):
                        initials = {x[0] for f in (first, *aside) for x in (f, *other.get(f, ()))}
                        found |= {f"f|{v}|{c}" for v in _variants(family) for c in initials}
                        found |= {f"o|{first}|{org}|{family[0]}"} if org else set()
                        found |= {f"p|{first}|{place}|{family[0]}"} if place else set()
                rows += [i] * len(found)
                keys += sorted(found)
            yield b.iloc[rows][["node", "system"]].assign(key=keys)

    keyed = stage(nodes.select("node", "system", "spelled", "org", "place").mapInPandas(run, "node string, system string, key string"), "keys")
    # what more than HOT nodes share is split: a left node is in one part, a right one goes to all of them
    sized = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("system").alias("s"), F.max("system").alias("t")).where("n > 1 AND s < t").select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    both = keyed.join(sized, "key")
    left = both.select("key", F.col("node").alias("a"), "system", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("k"))
    right = both.select("key", F.col("node").alias("b"), F.col("system").alias("system_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    return left.join(right, ["key", "k"]).where("a < b AND system <> system_b").select("a", "b").distinct()


def vote(pairs: DataFrame, nodes: DataFrame, first_names, shared_phones) -> DataFrame:
    """a, b and a column for each of ``VOTES``."""
    fields = ["spelled", "org", "place", "role", "phones", "handles", "same_name"]
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(f).alias(f"{f}_{x}") for f in fields))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, switchboards = first_names.value, shared_phones.value
        for b in batches:
            votes = []
            for r in b.itertuples(index=False):
                pa, pb = _unspelled(r.spelled_a), _unspelled(r.spelled_b)
                score = same_person(pa, pb, names)
                pha, phb = set(r.phones_a.split()), set(r.phones_b.split())
                phone = 0 if not pha or not phb else 1 if not pha & phb else 3 if (pha & phb) - switchboards else 2
                handles = [_names_handle(r.handles_a.split(), pb[0]), _names_handle(r.handles_b.split(), pa[0])]
                votes.append((1 if score <= 0 else 4 if score >= 0.99 else 3 if score >= 0.8 else 2, 1 if r.same_name_a <= 1 and r.same_name_b <= 1 else 2, _same_words(r.org_a, r.org_b), _same_place(r.place_a, r.place_b), _same_words(r.role_a, r.role_b), phone, 1 if 1 in handles else max(handles)))
            out = b[["a", "b"]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(votes, columns=list(VOTES), dtype=np.int32)], axis=1)

    return both.mapInPandas(run, "a string, b string, " + ", ".join(f"{v} int" for v in VOTES))


class LabelModel:
    """p(match), and in each class (one person, strangers, namesakes) the votes as a tree of dependencies learned from all combinations of votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, votes: dict[str, int] = VOTES, start: np.ndarray | None = None, nameless: float = NAMELESS) -> None:
        """``start``: log odds from which learning begins in place of ``_PRIOR`` and the guesses of ``VOTES``; ``nameless``: the most that names of one person may differ."""
        self._sizes = list(votes.values())
        own = [v for v in votes if start is None or v not in VOTES]
        guess = (_PRIOR if start is None else start) + sum(np.array(_GUESS[v])[patterns[:, list(votes).index(v)]] for v in own)
        match = 1 / (1 + np.exp(-guess))
        # pairs that aren't one person are of two kinds, strangers and namesakes, which votes tell apart as well
        stranger = np.where(patterns[:, list(votes).index("name")] == 1, 0.95, 0.05)
        shares = np.stack([match, (1 - match) * stranger, (1 - match) * (1 - stranger)], 1)
        for _ in range(ROUNDS):
            logs = np.stack([np.log((w := shares[:, k] * counts).sum() + 1) + self._log_likelihood(patterns, w, nameless if k == 0 else 1.0) for k in range(3)], 1)
            logs -= logs.max(1, keepdims=True)
            new = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
            done = float(np.abs(new - shares).max(initial=0)) < 1e-6
            shares = new
            if done:
                break
        self.posterior = shares[:, 0]

    def _log_likelihood(self, patterns: np.ndarray, weight: np.ndarray, nameless: float) -> np.ndarray:
        """log p of each combination under the class's Chow-Liu tree, which is fitted on the way.

        An abstention says nothing: it counts in no table, and a vote whose parent abstains has its own frequency. ``nameless``
        bounds the share of the class's pairs whose names (the first vote) differ.
        """
        m = len(self._sizes)
        given = patterns > 0
        single = [np.bincount(patterns[:, k], weight * given[:, k], n)[1:] + 0.5 for k, n in enumerate(self._sizes)]
        single = [s / s.sum() for s in single]
        single[0][0] = min(single[0][0], nameless)
        single[0] /= single[0].sum()
        joint: dict[tuple[int, int], np.ndarray] = {}
        gain = np.zeros((m, m))
        for i in range(m):
            for j in range(m):
                if i != j:
                    both = weight * given[:, i] * given[:, j]
                    n = np.bincount(patterns[:, i] * self._sizes[j] + patterns[:, j], both, self._sizes[i] * self._sizes[j]).reshape(self._sizes[i], -1)[1:, 1:]
                    share = both.sum()
                    n = n + 4.0 * np.outer(single[i], single[j])  # few cases lean on independence
                    n /= n.sum()
                    joint[i, j] = n
                    gain[i, j] = share * (n * np.log(n / np.outer(n.sum(1), n.sum(0)))).sum()
        at = np.maximum(patterns - 1, 0)
        inside, out = {0}, np.where(given[:, 0], np.log(single[0])[at[:, 0]], 0.0)
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: gain[x])
            n = joint[i, j]
            after = np.log(n / n.sum(1, keepdims=True))[at[:, i], at[:, j]]
            out = out + np.where(given[:, j], np.where(given[:, i], after, np.log(single[j])[at[:, j]]), 0.0)
            inside.add(j)
        return out


def _posteriors(voted: DataFrame, votes: dict[str, int], start: str | None = None) -> DataFrame:
    """a, b, votes and the confidence that the model gives; the driver gets the counts of vote combinations, at most the product of ``votes``."""
    first = [F.avg(start).alias("start")] if start else []
    counted = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n"), *first).orderBy(*votes).toPandas()
    odds = np.log(np.clip(counted["start"], 1e-6, 1 - 1e-6) / (1 - np.clip(counted["start"], 1e-6, 1 - 1e-6))).to_numpy() if start else None
    counted["confidence"] = LabelModel(counted[list(votes)].to_numpy(np.int64), counted["n"].to_numpy(np.float64), votes, odds).posterior
    posterior = voted.sparkSession.createDataFrame(counted[[*votes, "confidence"]], ", ".join(f"{v} int" for v in votes) + ", confidence double")
    return voted.select("a", "b", *votes).join(F.broadcast(posterior), list(votes))


def _with_third(scored: DataFrame, nodes: DataFrame, first_names, switchboards) -> DataFrame:
    """scored and the pairs that only share surely linked third records, with the vote ``third`` and ``start``, the posterior so far.

    2: both are surely one person with a third record; 1: one of them surely is with a record of the other's system, and this pair isn't sure; else 0.
    """
    system = nodes.select("node", "system")
    sure = scored.where(F.col("confidence") >= SURE).select("a", "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
    beside = stage(sure.select(ends).select("e.*").join(system.withColumnRenamed("node", "y"), "y"), "sure")
    other = beside.select("x", F.col("y").alias("z"), F.col("system").alias("s2"))
    third = stage(beside.join(other, "x").where("y < z AND system <> s2").select(F.col("y").alias("a"), F.col("z").alias("b")).distinct(), "third")
    new = vote(third.join(scored, ["a", "b"], "left_anti"), nodes, first_names, switchboards).withColumn("confidence", F.lit(None).cast("double"))
    taken = beside.select(F.col("x"), F.col("system").alias("s")).distinct()
    sides = lambda k: system.withColumnRenamed("node", k).withColumnRenamed("system", f"s{k}")
    every = scored.unionByName(new).join(third.withColumn("three", F.lit(True)), ["a", "b"], "left").join(sides("a"), "a").join(sides("b"), "b")
    rival = lambda x, y: taken.select(F.col("x").alias(x), F.col("s").alias(f"s{y}"), F.lit(True).alias(f"rival_{x}"))
    every = every.join(rival("a", "b"), ["a", "sb"], "left").join(rival("b", "a"), ["b", "sa"], "left")
    unsure = F.coalesce("confidence", F.lit(0.0)) < SURE
    said = F.when(F.col("three"), 2).when(unsure & (F.col("rival_a") | F.col("rival_b") | (F.col("rival_a").isNull() & F.col("rival_b"))), 1).otherwise(0)
    return every.select("a", "b", *VOTES, said.cast("int").alias("third"), F.coalesce("confidence", F.lit(0.1)).alias("start"))


def _family_pairs(nodes: DataFrame) -> DataFrame:
    """family, first, second, agree of names of one family name in one place, for learning first names; ``agree`` is about roles."""
    words = F.split(plain("spelled"), " ")
    each = nodes.where((F.size(words) > 1) & (F.col("place") != "") & (F.col("role") != "")).select(F.element_at(words, -1).alias("family"), "place", "role", words[0].alias("first"))
    side = lambda x: each.select("family", "place", F.col("role").alias(f"r{x}"), F.concat_ws(" ", "first", "family").alias(x)).distinct()
    return relatives(side("a").join(side("b"), ["family", "place"]).where("a < b"), "a", "b", F.col("ra") == F.col("rb"))


def link_records(people: DataFrame) -> DataFrame:
    """Pairs of objects of different systems that are one person: left, right (smaller first), confidence.

    Objects that are alike in all attributes and system are one node, so a third of all rows being copies costs
    no pairs among the copies. The driver gets the counts of vote combinations and sends back
    their posteriors; nothing else leaves the executors. Every pair's confidence is a posterior, also of those that only share third records.

    Null and empty attributes and identifier lists abstain. Empty tables give an empty result.
    """
    sc = people.sparkSession.sparkContext
    alike = ["system", "spelled", "org", "place", "role", "phones", "handles"]
    every = stage(records(people), "records")
    named = every.groupBy(*alike).agg(F.min("id").alias("node"))
    alone = stage(named, "alone")
    namesakes = alone.groupBy("system", "spelled").agg(F.count(F.lit(1)).alias("same_name"))
    nodes = stage(alone.join(namesakes, ["system", "spelled"]), "nodes")
    first_names = sc.broadcast(learn_first_names(nodes, _family_pairs(nodes)))
    total = nodes.count()
    often = nodes.select(F.explode(F.split("phones", " ")).alias("p")).where("p <> ''").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(max(20.0, total * SHARED_PHONE)))
    switchboards = sc.broadcast({r["p"] for r in often.collect()})  # of four digits: at most 10,000
    voted = stage(vote(candidates(nodes, first_names).repartition("a"), nodes, first_names, switchboards), "votes")
    scored = stage(_posteriors(voted, VOTES), "scored")
    again = stage(_with_third(scored, nodes, first_names, switchboards), "votes_again")
    linked = _posteriors(again, VOTES | THIRD, "start").where(F.col("confidence") >= LINK).select("a", "b", "confidence")
    members = every.join(nodes, alike).select("node", "id")
    left, right = members.select(F.col("node").alias("a"), F.col("id").alias("i")), members.select(F.col("node").alias("b"), F.col("id").alias("j"))
    spread = linked.join(left, "a").join(right, "b")
    return spread.select(F.least("i", "j").alias("left"), F.greatest("i", "j").alias("right"), "confidence")


def p1_linked(spark, d: str) -> DataFrame:
    """Pairs of one person with the confidence: left_source_object_id, right_source_object_id, confidence."""
    found = link_records(spark.read.parquet(f"{d}/review_source.parquet"))
    return found.select(F.col("left").alias("left_source_object_id"), F.col("right").alias("right_source_object_id"), F.round("confidence", 6).alias("confidence"))


def p1_found(spark, d: str) -> DataFrame:
    """Pairs of one person: left_source_object_id, right_source_object_id."""
    return p1_linked(spark, d).select("left_source_object_id", "right_source_object_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_linked": p1_linked}
SQL: dict[str, str] = {}
