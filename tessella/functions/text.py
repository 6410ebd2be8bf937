"""Text expressions: normal forms, tokens, anchors, numbers and times in text, and repairs of model output."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a lexical query leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with",
)
#: What a question without any word to look for asks about.
DEFAULT_TERM = "enterprise"


def collapsed(x: Column) -> Column:
    """Trimmed, inner white space as single spaces, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), " +", " "))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility form; there is no built-in expression for it."""
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def slug(x: Column) -> Column:
    """Letters and digits with single underscores between, and between a small and a capital letter."""
    apart = F.regexp_replace(F.trim(x), "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(apart), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words(x: Column) -> Column:
    """ASCII words and numbers in lower case, in order."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(x: Column, most: int = 24) -> Column:
    """The terms of a lexical query: words of two letters or more that aren't stopwords, each once, the first ``most``."""
    kept = F.array_distinct(F.filter(words(x), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, most)).otherwise(F.array(F.lit(DEFAULT_TERM)))


def singular(w: Column) -> Column:
    """A word without a plural ending: -ies as -y, -s but for -ss."""
    return F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("[^s]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)


def anchors(x: Column) -> Column:
    """What a text names literally: ticket numbers, versions, quoted words; distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"[A-Z][A-Z0-9]+-[0-9]+|v[0-9]+(?:\.[0-9]+)+|[0-9a-f]{7,}"), F.lit(0)))


def percentage(x: Column) -> Column:
    """The one percentage that a text states, as a number; null without or with several."""
    found = F.regexp_extract_all(x, F.lit(r"([0-9]+(?:\.[0-9]+)?) ?%"), F.lit(1))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).cast("double"))


def latest_date(x: Column) -> Column:
    """The latest ISO date in a text."""
    found = F.regexp_extract_all(x, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))
    return F.array_max(F.transform(found, lambda d: d.try_cast("date")))


def version_rank(x: Column) -> Column:
    """The number that ends a version's name; 0 without one."""
    return F.coalesce(F.regexp_extract(x, "([0-9]+)$", 1).try_cast("int"), F.lit(0))


def seconds(value: Column, unit: Column) -> Column:
    """A duration in seconds; null for an unknown unit. Negative zero is zero."""
    u = F.lower(F.trim(unit))
    factor = F.when(u.isin("ms", "millisecond", "milliseconds"), 0.001).when(u.isin("s", "sec", "second", "seconds"), 1.0).when(u.isin("m", "min", "minute", "minutes"), 60.0).when(u.isin("h", "hour", "hours"), 3600.0)
    return value * factor + F.lit(0.0)


def fact_key(kind: Column, number: Column, unit: Column, values: Column) -> Column:
    """The key under which two facts are the same: durations in seconds, texts collapsed, sets in order."""
    numeric = F.call_function("format_number", F.when(kind == "duration", seconds(number, unit)).otherwise(number + F.lit(0.0)), F.lit("0.######"))
    return F.concat_ws(":", kind, F.when(kind.isin("duration", "number", "percentage"), numeric).otherwise(F.array_join(F.array_sort(F.array_distinct(F.transform(values, collapsed))), "|")))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where there is nothing to divide by."""
    return F.try_divide(n.cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))


def f1(precision: Column, recall: Column) -> Column:
    """Their harmonic mean; 0 if both are 0, null if either is."""
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def unwrapped_json(x: Column) -> Column:
    """A model's reply without its thinking, code fence and trailing commas."""
    plain = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.regexp_replace(F.when(fenced != "", fenced).otherwise(plain), r"^\s+|\s+$", ""), r",\s*([}\]])", "$1")


@F.pandas_udf(T.StringType())
def complete_prefix(x: pd.Series) -> pd.Series:
    """The first whole JSON value of a reply that goes on, or breaks off, behind it; null without one."""

    def first(text: str | None) -> str | None:
        for m in re.finditer(r"[\[{]", text or ""):
            try:
                value, _ = json.JSONDecoder().raw_decode(text, m.start())
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return None

    return x.map(first)


@F.pandas_udf(T.BooleanType())
def quoted_in(quote: pd.Series, source: pd.Series) -> pd.Series:
    """Whether a quote stands in its source, but for white space, case and compatibility forms."""
    plain = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()) if t else ""
    return pd.Series([bool(plain(q)) and plain(q) in plain(s) for q, s in zip(quote, source, strict=True)])
