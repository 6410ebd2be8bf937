"""Checks of requests, manifests, labels, model replies and frozen results: each gives a fault, null where all holds."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.ids import stable_id
from tessella.functions.text import collapsed, quoted_in, slug

#: Names that only an evaluation may know.
FORBIDDEN = ("expected_doc_ids", "gold_answer", "answer_facts", "question_type", "expectedVerdict", "selectedAnswer", "evaluation_labels")
VERDICTS = ("SUPPORTED", "DISPUTED", "NOT_FOUND", "UNKNOWN")


def first_fault(checks: dict[str, Column]) -> Column:
    """The name of the first check that doesn't hold (null counts as not holding); null where all do."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(checks.items())):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def request_fault(question: Column, entity: Column, predicate: Column, scope: Column, scopes: list[str]) -> Column:
    """A dossier's request: a question of 8 to 240 characters, a name, a slug and a known scope."""
    n = F.length(F.trim(question))
    return first_fault({"question": n.between(8, 240), "entity": entity.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} ._:@-]{0,119}$"), "predicate": predicate.rlike("^[a-z][a-z0-9_]{0,63}$"), "scope": scope.isin(*scopes)})


def manifest_fault(keys: Column, allowed: list[str], question: Column, sources: Column, documents: Column, most: int) -> Column:
    """A runtime manifest's case: no other keys, a question, sources, 1 to ``most`` documents."""
    return first_fault({"keys": F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0, "question": F.length(F.trim(question)) > 0, "sources": F.size(F.array_compact(sources)) > 0, "documents": documents.between(1, most)})


def sorted_sources(sources: Column) -> Column:
    """Sources as a manifest keeps them: in order, each once, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(sources)))


def label_faults(labels: DataFrame, key: str, verdict: str, evidence: str) -> DataFrame:
    """labels with ``fault``: a key that is missing or repeated, an unknown verdict, evidence that is missing where the verdict needs some."""
    n = labels.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    joined = labels.join(n, key, "left")
    need = ~F.col(verdict).isin("SUPPORTED", "DISPUTED") | (F.size(evidence) > 0)
    fault = first_fault({"no_key": F.col(key).isNotNull(), "repeated": F.col("__n") == 1, "verdict": F.col(verdict).isin(*VERDICTS), "evidence": need})
    return joined.withColumn("fault", fault).drop("__n")


def accounting_faults(listed: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """key, fault of a frozen holdout: exactly one attempt for each listed case and none for others."""
    n = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = listed.select(key, F.lit(True).alias("listed")).distinct().join(n, key, "full")
    fault = F.when(F.col("listed").isNull(), "unlisted").when(F.col("n").isNull(), "not_run").when(F.col("n") > 1, "run_again")
    return both.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def _forbidden_path(value, names: frozenset[str], texts: bool, path: str = "$") -> str | None:
    if isinstance(value, dict):
        for k, v in value.items():
            if k in names:
                return f"{path}.{k}"
            if found := _forbidden_path(v, names, texts, f"{path}.{k}"):
                return found
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if found := _forbidden_path(v, names, texts, f"{path}[{i}]"):
                return found
    elif texts and isinstance(value, str) and any(n in value for n in names):
        return path
    return None


def _loaded(text: str | None):
    """A JSON text's value; None for null and broken texts."""
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def forbidden_path(x: Column, names: tuple[str, ...] = FORBIDDEN, texts: bool = False) -> Column:
    """Where a JSON text first uses a forbidden name as a key (or, with ``texts``, within a string) at any depth; null where nowhere."""
    chosen = frozenset(names)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _forbidden_path(_loaded(t), chosen, texts))

    return run(x)


def json_digest(x: Column) -> Column:
    """sha256 of a JSON text with all keys in order and no white space, so that equal values have equal digests; null for broken texts."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            v = _loaded(t)
            return None if v is None else hashlib.sha256(json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

        return s.map(one)

    return run(x)


def json_normal(x: Column) -> Column:
    """A JSON text with keys in order and all its strings collapsed and in lower case, at any depth; null for broken texts."""

    def normal(v):
        if isinstance(v, str):
            return " ".join(v.split()).lower()
        if isinstance(v, list):
            return [normal(i) for i in v]
        return {k: normal(v[k]) for k in sorted(v)} if isinstance(v, dict) else v

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (v := _loaded(t)) is None else json.dumps(normal(v), ensure_ascii=False, separators=(",", ":")))

    return run(x)


def json_at(x: Column, pointer: str) -> Column:
    """The value at a JSON pointer (with ~0 and ~1 unescaped), as JSON; null where there is none."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]

    def at(v):
        for p in parts:
            if isinstance(v, list) and p.isdigit() and int(p) < len(v):
                v = v[int(p)]
            elif isinstance(v, dict) and p in v:
                v = v[p]
            else:
                return None
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (v := _loaded(t)) is None else at(v))

    return run(x)


def timed_keys(m: Column) -> Column:
    """The entries of a map whose keys name a time, in order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: k.rlike(r"(?i)(_at|At|date|time|timestamp)$")))))


_NUMBER = re.compile(r"-?\d+(?:\.\d+)?$")


@F.pandas_udf(T.BooleanType())
def value_in_quote(value: pd.Series, quote: pd.Series) -> pd.Series:
    """Whether a quote states a value: words in any case, spacing and compatibility form; numbers and yes or no as whole words."""

    def plain(t: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", t).casefold().split())

    def one(v: str | None, q: str | None) -> bool:
        if not v or not q or not plain(v):
            return False
        a, b = plain(v), plain(q)
        if _NUMBER.match(a) or a in ("true", "false"):
            return re.search(rf"(?<![\w.]){re.escape(a)}(?![\w]|\.\d)", b) is not None
        return a in b

    return pd.Series([one(v, q) for v, q in zip(value, quote, strict=True)])


def observation_fault(predicate: Column, value: Column, quote: Column, source: Column) -> Column:
    """An extracted observation: a slug, a value, a quote that stands in the source and states the value."""
    return first_fault({"predicate": predicate == slug(predicate), "value": F.length(F.trim(value)) > 0, "quote": F.length(F.trim(quote)) > 0, "ungrounded_quote": quoted_in(quote, source), "ungrounded_value": value_in_quote(value, quote)})


def grounded_responses(observations: DataFrame, response: str, fault: str) -> DataFrame:
    """response, status, reason: a response is accepted with all its observations or not at all; the reason is its least fault's class."""
    kind = F.when(F.col(fault).startswith("ungrounded"), "ungrounded_output").when(F.col(fault) == "malformed", "malformed_output").when(F.col(fault).isNotNull(), "invalid_schema")
    by = observations.groupBy(response).agg(F.count(F.lit(1)).alias("observations"), F.min(kind).alias("reason"))
    return by.select(response, F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason", "observations")


def numeric_fact(x: Column) -> Column:
    """kind, value, unit of an answer that is a percentage or holds a duration; null of others."""
    share = F.regexp_extract(F.trim(x), r"^(-?\d+(?:\.\d+)?)%$", 1)
    found = r"(?i)(-?\d+(?:\.\d+)?)\s*(milliseconds?|ms|seconds?|secs?|s|minutes?|mins?|hours?|hrs?)\b"
    number, unit = F.regexp_extract(x, found, 1), F.lower(F.regexp_extract(x, found, 2))
    named = F.when(unit.rlike("^(ms|millisecond)"), "milliseconds").when(unit.rlike("^s"), "seconds").when(unit.rlike("^min"), "minutes").otherwise("hours")
    fact = lambda kind, v, u: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"), u.alias("unit"))
    return F.when(share != "", fact("percentage", share, F.lit(None).cast("string"))).when(number != "", fact("duration", number, named))


def evidence_id(quote: Column, source: Column) -> Column:
    """The document that an evidence label names: a source object's id as the quote, else the last part of the source behind a middle dot."""
    whole = F.trim(quote)
    return F.when(whole.rlike("(?i)^source_object_[a-f0-9]+$"), whole).otherwise(F.trim(F.element_at(F.split(source, "·"), -1)))


def subject_hint(question: Column, otherwise: Column) -> Column:
    """The first name of parts and a number in a question (as in pay-12-eu); otherwise the given id."""
    found = F.regexp_extract(question, r"(?i)\b[a-z]+-\d+(?:-[a-z0-9]+)+\b", 0)
    return F.when(found != "", found).otherwise(otherwise)


def person_names(x: Column) -> Column:
    """Runs of two or three capitalised words."""
    return F.regexp_extract_all(x, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"), F.lit(0))


def names_alignment(x: Column) -> Column:
    """Whether a text is about who owns, is assigned or answers for something."""
    return x.rlike(r"(?i)owner|assignee|reporter|reviewer|responsible")


def naive_target(surface: Column) -> Column:
    """The baseline of alignment: three known surfaces, else the surface itself in capitals."""
    s = slug(surface)
    return F.when(s == "owner", "OWNS").when(s == "assignee", "ASSIGNED_TO").when(s == "reviewer", "REVIEWS").otherwise(F.upper(s))


def anchor_score(quote: Column, anchors: Column, near: int = 40) -> Column:
    """6 for each place where a quote names an anchor, -10 where words within ``near`` characters around it take it back.

    Anchors and quote are compared in lower case.
    """
    plain = F.lower(quote)
    taken = r"\b(?:not|deprecated|superseded|previous(?:ly)?|formerly)\b|updated\s+from"

    def one(a: Column) -> Column:
        parts = F.split(plain, F.concat(F.lit(r"\Q"), F.lower(a), F.lit(r"\E")), -1)
        places = F.sequence(F.lit(2), F.size(parts))
        start = lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i - 1), "x")) + (i - 2) * (F.length(a) - 1)
        around = lambda i: F.substr(plain, F.greatest(F.lit(1), start(i) - near + 1), F.least(F.lit(near), start(i)) + F.length(a) + near)
        scored = F.transform(places, lambda i: F.when(F.regexp_like(around(i), F.lit(taken)), -10).otherwise(6))
        return F.when((F.length(a) > 0) & (F.size(parts) > 1), F.aggregate(scored, F.lit(0), lambda x, y: x + y)).otherwise(0)

    return F.coalesce(F.aggregate(F.transform(anchors, one), F.lit(0), lambda x, y: x + y), F.lit(0))


#: What lifecycles and wordings of a quote and its title say about its precedence.
LIFECYCLE_SCORE = {"deprecated": -3, "proposal": 0, "approved": 2, "applied": 3, "unknown": 0}
QUOTE_SCORE = (
    (r"(?i)correct(?:ion|ed)|deprecated|replaced|supersed|outdated|old doc|\bwas\s+(?:\d|previous|formerly)|previous(?:ly)?|\bearlier\b", 5), (r"(?i)\blatest\b|\bmost recent\b", 6), (r"(?i)\bnow\b|\bupdated\b|\bcurrent\b|effective|finalized|post-merge", 3),
    (r"(?i)\b(?:requirements?|convention|guidance|sla)\b[^\n]{0,30}\bfinal(?:ized)?\b|\bfinal(?:ized)?\b[^\n]{0,40}\b(?:requirements?|convention|guidance|sla)\b|\brequires\b[^\n]{0,12}\bexactly\b", 10), (r"(?i)\bplanned\b|\bfuture\s+(?:product\s+)?release\b", -5), (r"(?i)\b(?:suggest|recommend)(?:s|ed|ing)?\b", -3),
)
TITLE_SCORE = ((r"(?i)post-merge", 4), (r"(?i)\bcurrent\b|\bfinal\b|\b2026\b|\bv\d+\b", 2), (r"(?i)draft|scratchpad|meeting|\b2025\b|initial", -2), (r"(?i)negotiat|proposal|email\s+thread", -3))
MARGIN, DATE_BONUS = 2, 10


def precedence_score(quote: Column, title: Column, lifecycle: Column, anchors: Column) -> Column:
    """How much an extraction's wording, title, lifecycle and the question's anchors speak for it."""
    points = lambda x, rules: sum((F.when(F.coalesce(x, F.lit("")).rlike(p), w).otherwise(0) for p, w in rules), F.lit(0))
    stage = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LIFECYCLE_SCORE.items() for x in kv)), F.coalesce(lifecycle, F.lit("unknown"))), F.lit(0))
    return stage + points(quote, QUOTE_SCORE) + points(title, TITLE_SCORE) + anchor_score(F.coalesce(quote, F.lit("")), anchors)


def promotions(extractions: DataFrame, case: str, order: list[str]) -> DataFrame:
    """case, left, right, skipped, winner, reason: a conflict out of the first two accepted extractions of each case.

    extractions: case, id, status, subject, value, score, dated, asks_latest and the columns of ``order``. Skipped are cases of fewer than two, of two
    subjects and of equal values. The higher score wins by ``MARGIN``, with ``DATE_BONUS`` for the later date where the question asks for the latest.
    """
    fine = extractions.where("status = 'accepted'")
    two = fine.withColumn("k", F.row_number().over(Window.partitionBy(case).orderBy(*order))).where("k <= 2")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    sides = two.groupBy(case).agg(*(of(k, c).alias(f"{s}_{c}") for k, s in ((1, "l"), (2, "r")) for c in ("id", "subject", "value", "score", "dated")), F.bool_or("asks_latest").alias("latest"))
    every = extractions.select(case).where(F.col(case).isNotNull()).distinct().join(sides, case, "left")
    later = lambda a, b: F.when(F.coalesce(F.col("latest") & (F.col(a) > F.col(b)), F.lit(False)), DATE_BONUS).otherwise(0)
    left, right = F.col("l_score") + later("l_dated", "r_dated"), F.col("r_score") + later("r_dated", "l_dated")
    skipped = F.when(F.col("r_id").isNull(), "needs_two_extractions").when(~F.col("l_subject").eqNullSafe(F.col("r_subject")), "subject_mismatch").when(collapsed(F.col("l_value")) == collapsed(F.col("r_value")), "no_contradiction")
    winner = F.when(skipped.isNull(), F.when(left - right >= MARGIN, "left").when(right - left >= MARGIN, "right").otherwise("unresolved"))
    reason = F.when(winner == "unresolved", F.when(left == right, "equal_precedence").otherwise("insufficient_margin")).when(winner.isNotNull(), "precedence")
    return every.select(case, F.col("l_id").alias("left"), F.col("r_id").alias("right"), skipped.alias("skipped"), winner.alias("winner"), reason.alias("reason"))


#: What a record's text shows by its structure, by kind of probe.
PROBES = {"author": r"(?i)(?:^|\n)\[?[^\n\]]*\]?\s?@?[\p{L}][\p{L}0-9_.-]*:\s", "message": r":\s+\S", "code_block": r"(?s)```.*?```", "from": r"(?i)(?:^|\n|\[')From:\s+", "to": r"(?i)(?:^|\n|\[')To:\s+", "date": r"(?i)(?:^|\n|\[')Date:\s+", "subject": r"(?i)(?:^|\n|\[')Subject:\s+"}


def section_label(x: Column, label: str) -> Column:
    """Whether a text has a section of this label: at a line's start or in a table, before a colon, bar or line end; escaped line ends count."""
    plain = F.replace(x, F.lit("\\n"), F.lit("\n"))
    return plain.rlike(r"(?i)(?:^|\n| \| |^#+\s*)" + re.escape(label) + r"(?:[ \t]*:|[ \t]*\||\r?\n|$)")


def schema_observations(records: DataFrame, item: str, system: str, text: str, probes: DataFrame) -> DataFrame:
    """item, system, surface, present of each record and each surface that its system should show. probes: system, surface, pattern."""
    own = records.select(item, system, F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n")).alias("__t")).join(probes.withColumnRenamed("system", system), system)
    return own.select(item, system, "surface", F.regexp_like("__t", F.col("pattern")).alias("present"))


def log_requests(x: Column) -> Column:
    """Of a server's log each finished completion: generated, prompt and cached tokens, milliseconds to the first, tokens a second, backend."""
    lines = F.filter(F.split(x, "\n"), lambda line: line.contains("completion done tokens="))
    get = lambda line, key, kind: F.regexp_extract(line, rf"{key}=([0-9.]+)", 1).try_cast(kind)
    made = F.transform(lines, lambda line: F.struct(get(line, "gen", "bigint").alias("generated"), get(line, "prompt", "bigint").alias("prompt"), get(line, "cache", "bigint").alias("cached"), get(line, "ttft", "double").alias("first_ms"), get(line, "tps", "double").alias("per_second"), F.regexp_extract(line, "backend=(gpu|cpu)", 1).alias("backend")))
    return F.filter(made, lambda r: r["generated"].isNotNull() & r["prompt"].isNotNull() & (r["backend"] != ""))


def run_digest(parts: dict[str, Column]) -> Column:
    """An id of a retrieval or decision that depends on what went in only: lists are taken in order."""
    return stable_id("input", F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))))


def frozen_faults(frozen: DataFrame, key: str, status: str, answer: str, evidence: str, reason: str, digest: str, digest_of: Column) -> DataFrame:
    """key, fault of a frozen result: completed ones have an answer and evidence and no reason, others a reason and no answer; the digest is that of the row."""
    done = F.col(status) == "completed"
    said, given, why = (F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)) for c in (answer, evidence, reason))
    fault = first_fault({"status": F.col(status).isin("completed", "rejected", "failed"), "answer": done == said, "evidence": ~done | given, "reason": done != why, "digest": F.col(digest) == digest_of})
    return frozen.select(key, fault.alias("fault"))
