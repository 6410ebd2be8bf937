"""Ranking without a window over a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salt_of(columns: list[str], salts: int) -> Column:
    """A salt in [0, salts) that depends on the named columns only, so retried tasks agree."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], salts: int, out: str = "rank") -> DataFrame:
    """Adds a dense numbering 1..n of each group, in salted runs of ``order``.

    The numbering is deterministic but follows salt before ``order``; use it where any
    fixed numbering will do. Each run is ranked by itself and shifted by the sizes of the runs before it,
    so a group with a third of all rows is spread over ``salts`` tasks.
    """
    salt, start = "__salt", "__start"
    salted = df.withColumn(salt, salt_of(order, salts))
    sizes = salted.groupBy(*group, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    ranked = salted.withColumn(out, F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order)))
    same = [ranked[c].eqNullSafe(starts[c]) for c in [*group, salt]]
    joined = ranked.join(starts, same, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (ranked[out] + starts[start]).cast("bigint").alias(out))
