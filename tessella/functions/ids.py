"""Stable identifiers and digests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(x: Column) -> Column:
    """A string as a JSON literal, null as ``null``; control characters escape in lower case."""
    escaped = F.to_json(F.struct(x.alias("v")))
    literal = F.regexp_extract(escaped, r'(?s)^\{"v":(.*)\}$', 1)
    lower = literal
    for digit in "ABCDEF":  # not behind a backslash of its own
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.when(x.isNull(), F.lit("null")).when(x.rlike(r"[\x00-\x1f]"), lower).otherwise(literal)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of string columns with its keys in order, whatever the order given."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{key}":'), json_string(fields[key])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def stable_id(namespace: str, value: Column) -> Column:
    """namespace_<24 hex digits> of a value's canonical JSON; equal values have equal ids in every run."""
    return F.concat(F.lit(namespace + "_"), F.substring(F.sha2(F.concat(F.lit(namespace), F.char(F.lit(0)), value), 256), 1, 24))


def int_id(x: Column) -> Column:
    """A 52-bit whole number from a string's digest, exact as a double."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 13), 16, 10).cast("bigint")


def pair_key(a: Column, b: Column) -> Column:
    """The same key for a pair in either orientation."""
    return F.concat(F.least(a, b), F.char(F.lit(0)), F.greatest(a, b))


def hash_share(x: Column, salt: str, parts: int) -> Column:
    """A number in [0, parts) that depends on a string and a salt only, for repeatable samples."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), x), 256), 1, 8), 16, 10).cast("bigint"), F.lit(parts))
