"""Measures: pairs, clusters, confusions, attempts, arms, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import f1, ratio


def nearest_rank(x: str, percent: int) -> Column:
    """The ceil(percent / 100 * n)-th smallest value that isn't null, in whole-number ranks, exact."""
    return F.expr(f"percentile_disc({percent / 100!r}) WITHIN GROUP (ORDER BY {x})")


def pair_quality(pairs: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of boolean columns by strata; ratios are null where nothing is counted."""
    t, g = F.col(truth), F.col(guess)
    counts = pairs.where(t.isNotNull() & g.isNotNull()).groupBy(*by).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    scored = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def cell_counts(clusters: DataFrame, item: str, cluster: str, truth: str) -> DataFrame:
    """cluster, truth, n: the rows of each cell; all cluster measures follow from them."""
    return clusters.where(F.col(cluster).isNotNull() & F.col(truth).isNotNull()).select(item, cluster, truth).distinct().groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))


def b_cubed(cells: DataFrame, cluster: str, truth: str) -> DataFrame:
    """precision, recall, f1 averaged over items, from cell counts: sum n^2 / |cluster| and sum n^2 / |class|."""
    sizes = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias(name))
    joined = cells.join(sizes(cluster, "__c"), cluster).join(sizes(truth, "__t"), truth)
    square = F.col("n").cast("double") * F.col("n")
    total = joined.agg(F.sum("n").alias("items"), F.sum(square / F.col("__c")).alias("p"), F.sum(square / F.col("__t")).alias("r"))
    out = total.select("items", ratio(F.col("p"), F.col("items")).alias("precision"), ratio(F.col("r"), F.col("items")).alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def purity(cells: DataFrame, cluster: str) -> DataFrame:
    """clusters, items, purity: the share of items in their cluster's largest class."""
    best = cells.groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    return best.agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("items"), ratio(F.sum("most"), F.sum("size")).alias("purity"))


def confusion(df: DataFrame, expected: str, actual: str, values: list[str]) -> DataFrame:
    """A dense row for each expected value: expected and a count column for each actual one."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], "v string").select(F.col("v").alias(expected))
    counted = df.groupBy(expected).pivot(actual, values).agg(F.count(F.lit(1)))
    return known.join(counted, expected, "left").select(expected, *(F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values))


def set_overlap(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """df with hits, misses and extras of two array columns, each taken as a set; null counts as empty."""
    e, a = (F.array_distinct(F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c]))) for c in (expected, actual))
    return df.withColumn("hits", F.size(F.array_intersect(e, a))).withColumn("misses", F.size(F.array_except(e, a))).withColumn("extras", F.size(F.array_except(a, e)))


def listed_overlap(df: DataFrame, key: list[str], case: str, actual: str, expected: DataFrame, item: str) -> DataFrame:
    """key, hits, misses and extras of an array column, as a set, against what its case expects, a table (case, item); only of cases that expect anything.

    ``key`` tells rows apart. Each item is looked up by its case, so a row costs what it has, not what its case expects. A null of the array counts as nothing.
    """
    want = expected.select(case, item).distinct()
    sizes = want.groupBy(case).agg(F.count(F.lit(1)).alias("__size"))
    each = df.join(sizes, case).select(*key, case, "__size", F.explode_outer(F.array_distinct(actual)).alias(item))
    found = each.join(want.withColumn("__hit", F.lit(True)), [case, item], "left").groupBy(*key, "__size").agg(F.count("__hit").alias("hits"), F.count(item).alias("__n"))
    return found.select(*key, "hits", (F.col("__size") - F.col("hits")).alias("misses"), (F.col("__n") - F.col("hits")).alias("extras"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b: how many rows, with repeats, either table has and the other lacks."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a"))
    return left.crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")))
