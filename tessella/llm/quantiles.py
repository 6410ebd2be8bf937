"""Percentiles of very large numeric columns, by mergeable signed logarithmic buckets.

A value x lies in the bucket (sign x, ceil(log |x| / log g)) with g = (1 + e) / (1 - e); any value of
a bucket is within the share e of the bucket's middle. Buckets of the same key add up, whatever partition
or day they come from, so stored counts answer for any set of days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.01
#: Shares as whole percents, so that ranks are whole numbers everywhere.
PERCENTS = (50, 95, 99)


def _growth(relative_error: float) -> float:
    return (1 + relative_error) / (1 - relative_error)


def bucket_counts(df: DataFrame, keys: list[str], value: str, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """keys, side (-1, 0, 1), bucket, n: how many finite values of each key fall into each bucket.

    Nulls, NaN and infinities don't count; negative values and zeros do. Null keys are a key. Counting is
    combined before the shuffle, so a key with a third of all rows costs no more than its buckets.
    """
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    index = F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.lit(math.log(_growth(relative_error))))).cast("int")
    return df.where(finite).groupBy(*keys, F.signum(x).cast("int").alias("side"), index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The counts of several tables of ``bucket_counts``, added up by ``keys``; fewer keys than they have roll up."""
    every = sketches[0]
    for other in sketches[1:]:
        every = every.unionByName(other)
    return every.groupBy(*keys, "side", "bucket").agg(F.sum("n").alias("n"))


def _middle(side: Column, bucket: Column, relative_error: float) -> Column:
    g = _growth(relative_error)
    return side * F.lit(2.0 / (1 + g)) * F.pow(F.lit(g), bucket)


def percentiles(sketch: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """keys, n and p<percent> columns: of each key, nearest-rank percentiles within ``relative_error`` of the exact ones.

    ``sketch`` must have been counted with the same error. A key's buckets are as many as its values have
    orders of magnitude times 1 / error at most, however many values there are. An empty sketch gives no rows.
    """
    value_order = [F.col("side"), F.col("side") * F.col("bucket")]
    upto = Window.partitionBy(*keys).orderBy(*value_order)
    whole = Window.partitionBy(*keys)
    ranked = sketch.withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(whole))
    middle = _middle(F.col("side"), F.col("bucket"), relative_error)
    # nearest rank: the ceil(share * n)-th smallest, in whole numbers
    wanted = [F.min(F.when(F.col("__upto") * 100 >= F.col("__all") * p, middle)).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*keys).agg(F.max("__all").alias("n"), *wanted)


def _once(rows: DataFrame) -> DataFrame:
    """A run once for its row_id, as loaded last; runs without an id all count."""
    kept = F.struct(F.col("loaded_at"), F.col("arm_id"), F.col("run_day"), F.col("latency_ms"))
    latest = rows.where("row_id IS NOT NULL").groupBy("row_id").agg(F.max(kept).alias("r")).select("r.*")
    return latest.unionByName(rows.where("row_id IS NULL").select("loaded_at", "arm_id", "run_day", "latency_ms"))


def arm_day_counts(rows: DataFrame) -> DataFrame:
    """Bucket counts of latency_ms by arm_id (trimmed, lower case, dashes as underscores) and run_day, each row_id once."""
    arm = F.replace(F.lower(F.trim("arm_id")), F.lit("-"), F.lit("_"))
    return bucket_counts(_once(rows).withColumn("arm_id", arm), ["arm_id", "run_day"], "latency_ms")


def p5_percentiles(spark, d: str) -> DataFrame:
    """Median, p95 and p99 latency by arm and day, by arm, by day and over all: grain, arm_id, run_day, n, p50, p95, p99."""
    base = arm_day_counts(spark.read.parquet(f"{d}/causal_score_row.parquet"))
    as_grain = lambda name, arm, day: F.struct(F.lit(name).alias("grain"), (F.col("arm_id") if arm else F.lit(None).cast("string")).alias("arm_id"), (F.col("run_day") if day else F.lit(None).cast("date")).alias("run_day"))
    grains = F.explode(F.array(as_grain("arm_day", 1, 1), as_grain("arm", 1, 0), as_grain("day", 0, 1), as_grain("all", 0, 0))).alias("g")
    rolled = merge_counts(base.select(grains, "side", "bucket", "n").select("g.*", "side", "bucket", "n"), keys=["grain", "arm_id", "run_day"])
    out = percentiles(rolled, ["grain", "arm_id", "run_day"])
    return out.select("grain", "arm_id", "run_day", "n", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in PERCENTS))


def p5_trailing_week(spark, d: str) -> DataFrame:
    """The same by arm over each run_day and the six days before it, from the stored day counts alone."""
    base = arm_day_counts(spark.read.parquet(f"{d}/causal_score_row.parquet")).where("run_day IS NOT NULL")
    until = F.explode(F.sequence(F.col("run_day"), F.date_add("run_day", 6))).alias("until_day")
    weeks = merge_counts(base.select("arm_id", until, "side", "bucket", "n"), keys=["arm_id", "until_day"])
    out = percentiles(weeks, ["arm_id", "until_day"])
    return out.select("arm_id", "until_day", "n", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in PERCENTS))


QUERIES = {"p5_percentiles": p5_percentiles, "p5_trailing_week": p5_trailing_week}

_G = repr(_growth(RELATIVE_ERROR))
_VALUES = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(row_id::VARCHAR, 'none' || rowid_)
                               ORDER BY loaded_at DESC NULLS LAST, arm_id DESC NULLS LAST, run_day DESC NULLS LAST, latency_ms DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM causal_score_row)),
v AS (
  SELECT replace(lower(trim(arm_id, ' ')), '-', '_') AS arm_id, run_day, latency_ms AS x FROM latest
  WHERE k = 1 AND latency_ms IS NOT NULL AND isfinite(latency_ms)),
"""
_PICKS = ", ".join(f"min(CASE WHEN r * 100 >= n * {p} THEN x END) AS x{p}" for p in PERCENTS)
_MIDDLES = ", ".join(f"CASE WHEN x{p} = 0 THEN 0.0 ELSE round(sign(x{p}) * (2.0 / (1 + {_G})) * pow({_G}, ceil(ln(abs(x{p})) / ln({_G}))), 6) END AS p{p}" for p in PERCENTS)
_KEYED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY x) AS r, count(*) OVER (PARTITION BY {k}) AS n FROM g), picked AS (SELECT {k}, max(n) AS n, " + _PICKS + " FROM ranked GROUP BY {k}) SELECT {k}, n, " + _MIDDLES + " FROM picked"
SQL = {
    "p5_percentiles": _VALUES
    + "g AS (SELECT 'arm_day' AS grain, arm_id, run_day, x FROM v UNION ALL SELECT 'arm', arm_id, NULL, x FROM v UNION ALL SELECT 'day', NULL, run_day, x FROM v UNION ALL SELECT 'all', NULL, NULL, x FROM v), "
    + _KEYED.format(k="grain, arm_id, run_day"),
    "p5_trailing_week": _VALUES
    + "g AS (SELECT arm_id, CAST(run_day + CAST(i AS INTEGER) AS DATE) AS until_day, x FROM v, range(7) t(i) WHERE run_day IS NOT NULL), "
    + _KEYED.format(k="arm_id, until_day"),
}
