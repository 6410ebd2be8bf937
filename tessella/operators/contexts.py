"""Contexts of experiment arms: removal with replacements of equal length, greedy choice of spans, precedence of wordings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import words


def replace_removed(contexts: DataFrame, case: str, item: str, removed: str, tokens: str, pool: DataFrame) -> DataFrame:
    """case, item, replacement: each removed item's stand-in from the pool of its case with as many tokens.

    The n-th removed item of a length takes the n-th spare item of that length, both by id; null where the pool has none left.
    pool: case, item, tokens; what is in the case's context is no spare.
    """
    spare = pool.join(contexts.select(case, item), [case, item], "left_anti")
    nth = F.row_number().over(Window.partitionBy(case, tokens).orderBy(item))
    gone = contexts.where(F.col(removed)).withColumn("__n", nth)
    stand_in = spare.withColumn("__n", nth).select(case, tokens, "__n", F.col(item).alias("replacement"))
    return gone.join(stand_in, [case, tokens, "__n"], "left").select(case, item, "replacement")


def diverse_spans(spans: DataFrame, case: str, span: str, score: str, most: int, budget: int, overlap: float = 0.7) -> DataFrame:
    """case, span, place: spans by falling score, but for those that share ``overlap`` of the smaller one's words with a chosen one, or don't fit.

    The choice depends on all chosen before, so a case is worked through by one task; ``spans`` should hold
    its best, as the ranking operators leave them.
    """
    kind = dict(spans.dtypes)[case]
    ordered = F.sort_array(F.collect_list(F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("score"), F.col(span).alias("span"))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, places = [], [], []
            for i in range(len(b)):
                kept, left = [], budget
                for text in b.column(1)[i].values:
                    if len(kept) == most:
                        break
                    text = text.as_py()
                    own = set(text.lower().split())
                    near = any(len(own & o) >= overlap * max(1, min(len(own), len(o))) for o in kept)
                    if len(text) <= left and not near:
                        kept.append(own)
                        left -= len(text)
                        rows.append(i)
                        texts.append(text)
                        places.append(len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(places, pa.int32())], names=[case, span, "place"])

    lists = spans.where(F.col(span).isNotNull() & F.col(case).isNotNull()).groupBy(case).agg(ordered.alias("__spans"))
    return lists.select(case, F.col("__spans")["span"].alias("__spans")).mapInArrow(choose, f"`{case}` {kind}, `{span}` string, place int")


#: Wordings that speak for or against the version that states them, with their weight.
PRECEDENCE = (
    (r"(?i)\b(final|approved|signed|in force|effective)\b", 3), (r"(?i)\b(correct(ed|ion)|supersedes?|replaces)\b", 3), (r"(?i)\b(after|since) [A-Z]+-[0-9]+ merged\b", 2), (r"(?i)\b(now|current(ly)?|latest)\b", 1),
    (r"(?i)\b(draft(ed)?|proposal|proposed|not applied)\b", -3), (r"(?i)\b(earlier|previous(ly)?|former|legacy|deprecated)\b", -2), (r"(?i)\b(was|were) capped\b", -1),
)


def precedence(text: Column) -> Column:
    """How much a text's wording speaks for what it states."""
    return sum((F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0)) for p, w in PRECEDENCE), F.lit(0))


def word_prefix(text: Column, count: Column | int) -> Column:
    """The first words of a text with the white space between them as it was."""
    n = count if isinstance(count, int) else None
    if n is None:
        return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), 1, count), "")
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), 1, n), "")


#: What must not stand in published text.
SECRETS = {"private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "access_key": r"\bAKIA[0-9A-Z]{16}\b", "bearer": r"(?i)\bbearer [a-z0-9._-]{20,}", "password": r"(?i)\bpassword\s*[:=]\s*\S+", "home_path": r"/(?:home|Users)/[a-z][a-z0-9_-]*/", "mail_address": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z]{2,})+\b", "handle": r"(?i)(?:^|\s)@[a-z][a-z0-9_-]*\.[a-z0-9._-]+"}


def scan(texts: DataFrame, item: str, text: str, patterns: dict[str, str] = SECRETS) -> DataFrame:
    """item, line, kind of each line that matches a pattern."""
    lines = texts.select(item, F.posexplode(F.split(text, "\n")).alias("i", "__x"))
    kinds = F.filter(F.array(*(F.when(F.col("__x").rlike(p), F.lit(k)) for k, p in patterns.items())), lambda x: x.isNotNull())
    return lines.select(item, (F.col("i") + 1).alias("line"), F.explode(kinds).alias("kind"))


def _fault(foreign: Column, verdict: str, answer: str) -> Column:
    silent = F.col(verdict).isin("UNKNOWN", "NOT_FOUND") & (F.length(F.trim(answer)) > 0)
    empty = (F.col(verdict) == "SUPPORTED") & (F.coalesce(F.length(F.trim(answer)), F.lit(0)) == 0)
    return F.when(foreign, "cites_what_it_lacks").when(silent, "answers_an_abstention").when(empty, "says_nothing")


def answer_checks(answers: DataFrame, cited: str, supplied: str, verdict: str, answer: str) -> DataFrame:
    """answers with ``fault``: null where an answer cites only what it was given and an abstention says nothing."""
    foreign = F.size(F.array_except(F.coalesce(cited, F.array().cast(dict(answers.dtypes)[cited])), F.coalesce(supplied, F.array().cast(dict(answers.dtypes)[supplied])))) > 0
    return answers.withColumn("fault", _fault(foreign, verdict, answer))


def answer_faults(answers: DataFrame, key: str, case: str, cited: str, verdict: str, answer: str, given: DataFrame, item: str) -> DataFrame:
    """key, verdict, answer, fault as ``answer_checks`` gives them, where what a case was given is a table (case, item) and not a list in each answer.

    Each citation is looked up by its case and item, so an answer costs what it cites, not what its case was given. A null citation is none.
    """
    each = answers.select(key, case, verdict, answer, F.explode_outer(F.array_distinct(cited)).alias(item))
    known = given.select(case, item).distinct().withColumn("__given", F.lit(True))
    foreign = F.bool_or(F.col(item).isNotNull() & F.col("__given").isNull()).alias("__foreign")
    own = each.join(known, [case, item], "left").groupBy(key, verdict, answer).agg(foreign)
    return own.select(key, verdict, answer, _fault(F.col("__foreign"), verdict, answer).alias("fault"))


def token_count(text: Column) -> Column:
    """ASCII words of a text; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


