"""Variant spellings of names, by n-gram vectors, a sparse cosine join and average-linkage clustering.

Names are folded to a small alphabet, so there are at most ``GRAMS`` trigrams and their weights are a table of
bounded size. Names meet through the trigrams of their prefix: rarest first, up to where the rest of a vector is too short
to reach the threshold alone, so no pair over the threshold is missed and no list of partners is cut. Firms' shared weights
are added up by pairs, and only pairs that can still reach the threshold are looked at. Names of persons are compared where they
first meet, if their family names allow it, so no pair is shuffled before it has reached the threshold. Pairs over it are checked
word by word, by first names learned from the data alone, and what remains is clustered by its cosines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.clustering import average_linkage
from tessella.llm.people import NO_COMPANY, FirstNames, firm_cost, firm_parts, name_parts, same_person
from tessella.staging import stage

if TYPE_CHECKING:
    from pyspark import Broadcast

_ALPHABET = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
GRAMS = len(_ALPHABET) ** 3
#: Cosine that two spellings must reach, of persons and of firms, and average similarity of a cluster.
PERSON_COSINE, FIRM_COSINE, LINKAGE = 0.35, 0.3, 0.2
#: A first name is one in its own right if this share of all names bears it; a short form, if this share shows it.
COMMON_SHARE, SHORT_SHARE, LEAST_COUNT = 1 / 10000, 1 / 20000, 3
#: Two first names are one if bearers of one family name agree in the hint in this share of their families, which are that
#: share of the rarer name's; they are different ones if fewer than ``APART`` of at least two families agree.
AGREE, OF_RARER, APART = 0.5, 0.15, 0.3
#: Names of a block with one trigram that a task pairs with each other; more are split over tasks.
HOT = 2048
#: Texts added to every trigram's count, so that slips, which are rare, don't outweigh the rest, nor few texts say much.
SEEN = 30
#: Vectors that a process remembers.
MEMO = 50_000
#: Cost up to which a firm's words are the listed ones.
FIRM_COST = 2.5


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a folded text's words, as numbers."""
    found = set()
    for w in text.split():
        codes = [0, *(_ALPHABET[c] for c in w), 0]
        n = len(_ALPHABET)
        found.update((a * n + b) * n + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    return np.array(sorted(found), dtype=np.int64)


def gram_weights(nodes: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency of every trigram over all nodes; the driver gets at most ``GRAMS`` counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(GRAMS + 1, np.int64)
        for b in batches:
            for t in b[text]:
                n[grams(t)] += 1
                n[GRAMS] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": n[at]})

    rows = nodes.select(text).mapInPandas(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(GRAMS + 1, np.float64)
    n[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return np.log((SEEN + n[GRAMS]) / (SEEN + n[:GRAMS])) + 0.1


def _vector(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = grams(text)
    w = weights[g]
    return g, w / (np.sqrt((w * w).sum()) or 1.0)


class Cosines:
    """Cosines of texts under a table of weights; vectors are remembered in a process, up to ``MEMO``."""

    def __init__(self, weights: np.ndarray) -> None:
        self._weights = weights
        self._vectors: dict[str, dict[int, float]] = {}

    def _of(self, text: str) -> dict[int, float]:
        found = self._vectors.get(text)
        if found is None:
            if len(self._vectors) >= MEMO:
                self._vectors.clear()
            g, w = _vector(text, self._weights)
            found = self._vectors[text] = dict(zip(g.tolist(), w.tolist(), strict=True))
        return found

    def __call__(self, a: str, b: str) -> float:
        x, y = self._of(a), self._of(b)
        return sum(x[g] * y[g] for g in x.keys() & y.keys())


def _prefix(g: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a unit vector's heaviest trigrams, up to where the rest is too short to reach the threshold; and the square length of what follows each."""
    order = np.argsort(-w, kind="stable")
    rest = 1 - np.cumsum(w[order] ** 2)
    n = int((rest >= threshold**2).sum()) + 1
    return order[:n], rest[:n]


def _postings(texts: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """block, id, gram, part, after of each trigram of the prefix of each text's vector.

    ``part`` is the gram's share of the unit vector, ``after`` the length of what follows it in the order of weights. texts: block, text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, grams_, parts, afters = [], [], [], []
            for i, t in enumerate(b["text"]):
                g, w = _vector(t, weights.value)
                keep, rest = _prefix(g, w, threshold)
                rows += [i] * len(keep)
                grams_.append(g[keep])
                parts.append(w[keep])
                afters.append(np.sqrt(np.maximum(0.0, rest)))
            out = b.iloc[rows][["block", "id"]].copy()
            flat = lambda x: np.concatenate(x) if x else np.zeros(0)
            out["gram"], out["part"], out["after"] = flat(grams_).astype(np.int32), flat(parts).astype(np.float32), flat(afters).astype(np.float32)
            yield out

    return texts.select("block", F.xxhash64("block", "text").alias("id"), "text").mapInPandas(run, "block string, id bigint, gram int, part float, after float")


def _meetings(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """a, b of texts that share prefix grams: what these give (``shared``), and the most that others could add (``rest``).

    All grams of a pair that aren't counted follow its last counted one in either vector, so the product of what follows bounds them.
    ``right`` null pairs ``left`` with itself (a < b). What more than ``HOT`` names of a block share is split: each of
    its left names is in one part, and each of its right ones goes to all of them.
    """
    keys = ["block", "gram"]
    own = right is None
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where("n > 1") if own else counts.join(right.select(*keys).distinct(), keys, "left_semi")
    sized = counts.select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    a = left.join(sized, keys).select(*keys, F.col("id").alias("a"), F.col("part").alias("pa"), F.col("after").alias("ra"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("k"))
    b = (left if own else right).join(sized, keys).select(*keys, F.col("id").alias("b"), F.col("part").alias("pb"), F.col("after").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    met = a.join(b, [*keys, "k"])
    met = met.where("a < b") if own else met
    return met.groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("shared"), F.min(F.col("ra") * F.col("rb")).alias("rest"))


def near_texts(left: DataFrame, right: DataFrame | None, weights: Broadcast, threshold: float) -> DataFrame:
    """block, a, b, similarity of all pairs of texts of a block whose cosine is ``threshold`` or more.

    left, right: block, text, distinct; ``right`` null pairs ``left`` with itself, each pair once. Exact: what the shared prefix grams
    give and the others could add decides which pairs are compared as a whole.
    """
    ours = stage(_postings(left, weights, threshold), "postings")
    theirs = None if right is None else stage(_postings(right, weights, threshold), "postings")
    possible = _meetings(ours, theirs).where(F.col("shared") + F.col("rest") >= threshold - 1e-4).select("a", "b")
    named = lambda x, side: x.select(F.xxhash64("block", "text").alias(side), F.col("block").alias(f"block_{side}"), F.col("text").alias(f"text_{side}"))
    both = possible.join(named(left, "a"), "a").join(named(left if right is None else right, "b"), "b").where("block_a = block_b").select(F.col("block_a").alias("block"), F.col("text_a").alias("a"), F.col("text_b").alias("b"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine = Cosines(weights.value)
        for b in batches:
            b["similarity"] = np.fromiter((cosine(x, y) for x, y in zip(b["a"], b["b"], strict=True)), np.float64, len(b))
            yield b[b["similarity"] >= threshold]

    return both.mapInPandas(score, "block string, a string, b string, similarity double")


def _marks(text: str) -> tuple[int, int]:
    """Which letters the first and the last word of a text have, as bits; a slip changes two of them at most."""
    words = text.split(" ")
    return tuple(reduce(or_, (1 << ord(c) % 31 for c in w), 0) for w in (words[0], words[-1]))


def _akin(a: str, b: str) -> Column:
    """Whether the texts in two columns, with their ``_marks`` in ``_head`` and ``_tail``, may be one person's or have one family name.

    True wherever ``same_person`` or ``relatives`` finds them so: two slips in a word are at most four changes of letters. A longer expression
    would be more than Java compiles at once.
    """
    ends = {"head": 1, "tail": -1}
    alike = lambda i, j: (F.bit_count(F.col(f"{a}_{i}").bitwiseXOR(F.col(f"{b}_{j}"))) <= 4) & (F.levenshtein(F.substring_index(a, " ", ends[i]), F.substring_index(b, " ", ends[j]), 4) >= 0)
    return reduce(or_, (alike(i, j) for i in ends for j in ends))


def near_spellings(nodes: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """block, a_spelled, b_spelled, similarity, a_hint, b_hint of all pairs of nodes of a block whose texts differ, may be akin and have a cosine of ``threshold`` or more.

    nodes: block, text, spelled, hint. Exact, as ``near_texts``, but a pair is compared where it meets: at the first trigram that
    both prefixes hold. What more than ``HOT`` texts of a block share is split as there.
    """
    keys = ["block", "gram"]
    texts = nodes.groupBy("block", "text").agg(F.to_json(F.collect_list(F.struct("spelled", "hint"))).alias("own"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors, marks = (_vector(t, weights.value) for t in b["text"]), [_marks(t) for t in b["text"]]
            grams_ = [g[_prefix(g, w, threshold)[0]].astype(np.int32) for g, w in vectors]
            yield pd.DataFrame({"block": b["block"], "text": b["text"], "grams": grams_, "head": [m[0] for m in marks], "tail": [m[1] for m in marks]})

    found = texts.where(F.contains(F.col("text"), F.lit(" "))).select("block", "text").mapInPandas(prefixes, "block string, text string, grams array<int>, head int, tail int")
    held = stage(found.join(texts, ["block", "text"]), "prefixes")
    each = held.select("block", "text", "own", "head", "tail", F.explode("grams").alias("gram"))
    hot = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    sized = each.join(F.broadcast(stage(hot, "hot")), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = lambda c, k: sized.select(*keys, F.col("text").alias(c), F.col("own").alias(f"own_{c}"), F.col("head").alias(f"{c}_head"), F.col("tail").alias(f"{c}_tail"), k.alias("k"))
    left, right = side("a", F.pmod(F.xxhash64("text"), "parts").cast("int")), side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = left.join(right, [*keys, "k"]).where((F.col("a") < F.col("b")) & _akin("a", "b"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine, firsts = Cosines(weights.value), {}

        def first(text: str) -> frozenset[int]:
            if text not in firsts:
                if len(firsts) >= MEMO:
                    firsts.clear()
                g, w = _vector(text, weights.value)
                firsts[text] = frozenset(g[_prefix(g, w, threshold)[0]].tolist())
            return firsts[text]

        for b in batches:
            once = np.fromiter((g == min(first(x) & first(y)) for g, x, y in zip(b["gram"], b["a"], b["b"], strict=True)), bool, len(b))
            b = b[once].copy()
            b["similarity"] = np.fromiter((cosine(x, y) for x, y in zip(b["a"], b["b"], strict=True)), np.float64, len(b))
            b = b[b["similarity"] >= threshold]
            rows = [(k, x["spelled"], y["spelled"], s, x.get("hint"), y.get("hint")) for k, p, q, s in zip(b["block"], b["own_a"], b["own_b"], b["similarity"], strict=True) for x in json.loads(p) for y in json.loads(q)]
            yield pd.DataFrame(rows, columns=["block", "a_spelled", "b_spelled", "similarity", "a_hint", "b_hint"])

    return met.select("block", "gram", "a", "b", "own_a", "own_b").mapInPandas(score, "block string, a_spelled string, b_spelled string, similarity double, a_hint string, b_hint string")


def spelled(name: str | None) -> str:
    """A name's words, and behind a bar those given aside."""
    words, aside = name_parts(name)
    return " ".join(words) + ("|" + " ".join(aside) if aside else "")


def _unspelled(text: str) -> tuple[list[str], list[str]]:
    words, _, aside = text.partition("|")
    return words.split(), aside.split()


def plain(column: str):
    """The spelled name without what was given aside."""
    return F.regexp_replace(column, r"\|.*", "")


def learn_first_names(nodes: DataFrame, near: DataFrame | None = None) -> FirstNames:
    """First names in their own right, forms of one name, and names that tell relatives apart, from all names of the data.

    nodes: spelled. near: family, first, second (first names that are seen with this family name in one place), agree (0 or 1:
    whether their bearers agree in the hint). Forms also are those given aside. At most 1 / share of each reach the driver.
    """
    words = F.split(F.element_at(F.split("spelled", r"\|"), 1), " ")
    first = nodes.where(F.size(words) > 1).select(words[0].alias("first"), F.try_element_at(F.split(F.try_element_at(F.split("spelled", r"\|"), F.lit(2)), " "), F.lit(1)).alias("aside"))
    total = first.count()
    often = lambda share, least=LEAST_COUNT: F.col("n") >= F.lit(max(least, total * share))
    bearers = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    common = {r["first"] for r in bearers.where((F.length("first") > 2) & often(COMMON_SHARE)).collect()}
    pairs = {(r["first"], r["aside"]) for r in first.where("aside IS NOT NULL AND length(aside) > 1").groupBy("first", "aside").agg(F.count(F.lit(1)).alias("n")).where(often(SHORT_SHARE)).collect()}
    if near is None:
        return FirstNames(common, pairs)
    each = near.groupBy("family", "first", "second").agg(F.max("agree").alias("agree"))
    seen = each.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.sum("agree").alias("agree"))
    own = lambda c: bearers.select(F.col("first").alias(c), F.col("n").alias(f"n_{c}"))
    rated = seen.join(own("first"), "first", "left").join(own("second"), "second", "left").na.fill(1, ["n_first", "n_second"])
    same = (F.col("agree") >= AGREE * F.col("n")) & (F.col("n") >= OF_RARER * F.least("n_first", "n_second"))
    other = (F.col("n") > 1) & (F.col("agree") < APART * F.col("n"))
    rows = rated.where((same | other) & often(SHORT_SHARE / 10, 1)).select("first", "second", "agree", (F.col("n_first") < F.col("n_second")).alias("turned"), same.alias("same")).collect()
    # a rare word is a form of what it is seen with most, unless it's a slip of another name
    slips = {v for w in common if len(w) > 3 for v in _one_less(w)}
    forms: dict[str, tuple[int, set[str]]] = {}
    for r in (r for r in rows if r["same"]):
        rare, full = (r["first"], r["second"]) if r["turned"] else (r["second"], r["first"])
        best, found = forms.get(rare, (0, set()))
        if r["agree"] > best:
            forms[rare] = (r["agree"], {full})
        elif r["agree"] == best:
            found.add(full)
    for rare, (agree, full) in forms.items():
        if len(full) == 1 and (agree > 1 or rare in common or not (_one_less(rare) & slips)):
            pairs.add((*full, rare))
    return FirstNames(common, pairs, {(r["first"], r["second"]) for r in rows if not r["same"]})


def _one_less(word: str) -> set[str]:
    """A word and what it is with one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def relatives(pairs: DataFrame, a: str, b: str, agree) -> DataFrame:
    """family, first, second, agree of pairs of spelled names with one family name and two first names (for ``learn_first_names``)."""
    words = lambda c: F.split(plain(c), " ")
    last = lambda c: F.element_at(words(c), -1)
    one, two = words(a)[0], words(b)[0]
    full = (F.size(words(a)) > 1) & (F.size(words(b)) > 1) & (F.length(one) > 1) & (F.length(two) > 1)
    return pairs.where(full & agree.isNotNull() & (last(a) == last(b)) & (one != two)).select(last(a).alias("family"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"), agree.cast("int").alias("agree"))


def spell(df: DataFrame, item: str, name: str, block: str, hint: str | None = None) -> DataFrame:
    """block, id, spelled, hint of the rows that have the first three; repeated rows once."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["spelled"] = [spelled(x) for x in b["spelled"]]
            yield b[b["spelled"].str.contains("[a-z]", regex=True)]

    have = F.col(item).isNotNull() & F.col(name).isNotNull() & F.col(block).isNotNull()
    given = df.where(have).select(F.col(block).cast("string").alias("block"), F.col(item).alias("id"), F.col(name).alias("spelled"), F.lower(F.trim(F.col(hint) if hint else F.lit(None).cast("string"))).alias("hint"))
    return given.mapInPandas(run, f"block string, id {kinds[item]}, spelled string, hint string").distinct()


def near_names(df: DataFrame, item: str, name: str, block: str, threshold: float = PERSON_COSINE, hint: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records (block, id, spelled), nodes (block, spelled, hint) and the pairs of nodes of a block that may be akin and whose cosine is ``threshold`` or more."""
    records = stage(spell(df, item, name, block, hint), "spelled")
    nodes = stage(records.groupBy("block", "spelled").agg(F.min("hint").alias("hint")), "nodes")
    texts = stage(nodes.select("block", plain("spelled").alias("text")).distinct(), "texts")
    weights = df.sparkSession.sparkContext.broadcast(gram_weights(texts, "text"))
    near = near_spellings(nodes.withColumn("text", plain("spelled")), weights, threshold)
    # the nodes of two near texts, and those of one text that differ in what is given aside
    side = lambda x: nodes.select("block", plain("spelled").alias("a"), F.col("spelled").alias(f"{x}_spelled"), F.col("hint").alias(f"{x}_hint"))
    alike = side("a").join(side("b"), ["block", "a"]).where("a_spelled < b_spelled").withColumn("similarity", F.lit(1.0))
    columns = ["block", "a_spelled", "b_spelled", "similarity", "a_hint", "b_hint"]
    return records.select("block", "id", "spelled").distinct(), nodes, stage(near.unionByName(alike.select(*columns)), "pairs")


def cluster_names(records: DataFrame, pairs: DataFrame, first_names: FirstNames, linkage: float = LINKAGE) -> DataFrame:
    """id, cluster of all records: average linkage by the cosines of the pairs whose words are one person's."""
    learned = records.sparkSession.sparkContext.broadcast(first_names)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[same_person(_unspelled(x), _unspelled(y), learned.value) > 0 for x, y in zip(b["a_spelled"], b["b_spelled"], strict=True)]]

    checked = pairs.select("block", "a_spelled", "b_spelled", "similarity").mapInPandas(check, "block string, a_spelled string, b_spelled string, similarity double")
    node = lambda c: F.concat_ws("\x1f", F.col("block"), F.col(c))
    edges = checked.select(F.least(node("a_spelled"), node("b_spelled")).alias("a"), F.greatest(node("a_spelled"), node("b_spelled")).alias("b"), "similarity")
    clusters = average_linkage(stage(edges, "close"), linkage)
    placed = records.select("id", node("spelled").alias("node"))
    return placed.join(clusters, "node", "left").select("id", F.coalesce("cluster", "node").alias("cluster")).distinct()


def link_names(df: DataFrame, item: str, name: str, block: str, threshold: float = PERSON_COSINE, linkage: float = LINKAGE, hint: str | None = None) -> DataFrame:
    """id, cluster of every record whose name is a spelling of another's in the same ``block``.

    Records that share a block and a cluster mean one person. Equal spellings are one node, so a spelling that a
    third of all rows bear costs no pairs. ``hint`` names a column in which records of one person mostly agree and those of
    relatives don't (a role): what first names are forms of each other is learned from it, and nothing else. Null, empty and wordless
    names, null blocks and null ids are left out.
    """
    records, nodes, pairs = near_names(df, item, name, block, threshold, hint)
    return cluster_names(records, pairs, learn_first_names(nodes, _hinted(pairs)), linkage)


def _hinted(pairs: DataFrame) -> DataFrame:
    return relatives(pairs, "a_spelled", "b_spelled", F.col("a_hint") == F.col("b_hint"))


def _pairs(clusters: DataFrame) -> DataFrame:
    """left, right of all ids of one cluster, smaller first."""
    a, b = clusters.select(F.col("id").alias("left"), "cluster"), clusters.select(F.col("id").alias("right"), "cluster")
    return a.join(b, "cluster").where("left < right").select("left", "right").distinct()


def _parsed_firms(firms: DataFrame, columns: str) -> DataFrame:
    """``columns`` (among them ``typed``), core (the words) and legal (the form) of real firms."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [firm_parts(x) for x in b["typed"]]
            b["core"] = [" ".join(w) for w, _ in parts]
            b["legal"] = [x for _, x in parts]
            yield b[[c != "" and c.replace(" ", "") not in NO_COMPANY for c in b["core"]]]

    return firms.mapInPandas(parse, f"{columns}, core string, legal string")


def _written(cores: DataFrame, initials: bool) -> DataFrame:
    """core, text of each way in which a firm's words are written: as they are, together, and by their initials."""
    words = F.split("core", " ")
    ways = [F.col("core"), F.regexp_replace("core", " ", "")] + ([F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")] if initials else [])
    return cores.select("core", F.explode(F.array_distinct(F.array(*ways))).alias("text")).distinct()


def _near_firms(ours: DataFrame, theirs: DataFrame | None, weights: Broadcast, threshold: float) -> DataFrame:
    """core, other, similarity: the highest cosine of any two ways of writing them, from ``threshold``. ours, theirs: core, text."""
    texts = lambda x: x.select(F.lit("").alias("block"), "text").distinct()
    near = near_texts(texts(ours), None if theirs is None else texts(theirs), weights, threshold)
    left, right = ours.withColumnRenamed("text", "a"), (ours if theirs is None else theirs).select(F.col("core").alias("other"), F.col("text").alias("b"))
    met = near.join(left, "a").join(right, "b")
    if theirs is None:
        met = met.where("core <> other").select(F.least("core", "other").alias("core"), F.greatest("core", "other").alias("other"), "similarity")
    return met.groupBy("core", "other").agg(F.max("similarity").alias("similarity"))


def link_firms(typed: DataFrame, company: str, listed: DataFrame, key: str, listed_name: str, threshold: float = FIRM_COSINE) -> DataFrame:
    """typed, key, firm: of every company as typed, the one listed firm it means, and a name that all spellings of one firm share.

    A firm is meant where one way of writing it (its words, its words together, its initials) reaches the cosine with one of the
    typed one's, and its words (shortened, run together, reordered or with slips) are those typed at the least cost, and no other's
    at the same; legal forms break ties. ``key`` is null where no listed firm
    is meant; such spellings are clustered among themselves. Null and empty companies and words that stand for none have no row.
    """
    firms = stage(_parsed_firms(typed.where(F.col(company).isNotNull()).select(F.col(company).alias("typed")).distinct(), "typed string"), "firms")
    known = listed.where(F.col(listed_name).isNotNull() & F.col(key).isNotNull()).select(F.col(listed_name).alias("typed"), F.col(key).alias("key")).distinct()
    key_kind = dict(known.dtypes)["key"]
    known = stage(_parsed_firms(known, f"typed string, key {key_kind}").drop("typed"), "listed")
    ours, theirs = stage(_written(firms.select("core").distinct(), False), "ours"), stage(_written(known.select("core").distinct(), True), "theirs")
    weights = typed.sparkSession.sparkContext.broadcast(gram_weights(ours.select("text").unionByName(theirs.select("text")), "text"))
    near = _near_firms(ours, theirs, weights, threshold)
    pairs = near.join(firms, "core").join(known.select("key", F.col("core").alias("other"), F.col("legal").alias("legal2")), "other").select("typed", "core", "legal", "key", "other", "legal2")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            costs = []
            for c, g, c2, g2 in zip(b["core"], b["legal"], b["other"], b["legal2"], strict=True):
                costs.append(firm_cost(c.split(), c2.split()) + 0.3 * (g != "" and g != g2) + 0.1 * (g == ""))
            b["cost"] = costs
            yield b[b["cost"] <= FIRM_COST][["typed", "key", "cost"]]

    close = pairs.mapInPandas(score, f"typed string, key {key_kind}, cost double")
    best = Window.partitionBy("typed").orderBy("cost", "key")
    ranked = close.withColumn("r", F.row_number().over(best)).withColumn("next", F.lead("cost").over(best))
    meant = stage(ranked.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("next") > F.col("cost") + 1e-9))).select("typed", "key"), "meant")
    others = stage(firms.join(meant, "typed", "left_anti"), "unlisted")
    named = _cluster_firms(others, weights, threshold)
    listed_ones = meant.select("typed", "key", F.concat(F.lit("listed:"), F.col("key").cast("string")).alias("firm"))
    return listed_ones.unionByName(named.select("typed", F.lit(None).cast(key_kind).alias("key"), F.concat(F.lit("typed:"), "firm").alias("firm")))


def _cluster_firms(firms: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """typed, firm (the least words of the cluster) of parsed firms, clustered by their cosines where their words agree."""
    near = _near_firms(stage(_written(firms.select("core").distinct(), False), "unlisted_ways"), None, weights, threshold)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[min(firm_cost(x.split(), y.split()), firm_cost(y.split(), x.split())) <= FIRM_COST - 1 for x, y in zip(b["core"], b["other"], strict=True)]]

    edges = stage(near.mapInPandas(check, "core string, other string, similarity double").toDF("a", "b", "similarity"), "firm_pairs")
    clusters = average_linkage(edges, LINKAGE)
    return firms.join(clusters, firms["core"] == clusters["node"], "left").select("typed", F.coalesce("cluster", "core").alias("firm"))


def p4_found(spark, d: str) -> DataFrame:
    """Records of one person or firm: kind, left_key, right_key.

    What first names are one is learned from the employees' roles, for the customers too, whose roles tell little.
    """
    employees, customers, listed = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("herb_employee", "herb_customer", "org_reference"))
    keyed = lambda kind, pairs: pairs.select(F.lit(kind).alias("kind"), F.col("left").alias("left_key"), F.col("right").alias("right_key"))
    records, nodes, pairs = near_names(employees, "employee_id", "name", "org", hint="role")
    firms = link_firms(customers, "company", listed, "org_id", "company")
    placed = stage(customers.join(firms, customers["company"] == firms["typed"]).select("id", "name", customers["company"], "key", "firm"), "placed")
    client_records, client_nodes, client_pairs = near_names(placed, "id", "name", "firm")
    every = stage(nodes.select("spelled").unionByName(client_nodes.select("spelled")), "names")
    first_names = learn_first_names(every, _hinted(pairs))
    people, clients = _pairs(cluster_names(records, pairs, first_names)), _pairs(cluster_names(client_records, client_pairs, first_names))
    exact = listed.select(F.col("org_id").alias("key"), F.col("company").alias("exact")).distinct()
    written = placed.where("key IS NOT NULL AND id IS NOT NULL").join(exact, "key").where("company <> exact").select(F.lit("company").alias("kind"), F.col("id").alias("left_key"), F.col("key").alias("right_key"))
    return keyed("employee", people).unionByName(keyed("customer", clients)).unionByName(written).distinct()


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
