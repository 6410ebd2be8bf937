"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import salt_of

SALTS = 64


def best_scores(candidates: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Each item once in its group, with its highest score.

    Rows with a null group, item or score, or a NaN score, don't count.
    """
    usable = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    return candidates.where(usable).groupBy(group, item).agg(F.max(score).alias(score))


def top_n_per_group(candidates: DataFrame, limits: DataFrame, group: str, item: str, score: str, limit: str, salts: int = SALTS) -> DataFrame:
    """The ``limit`` best items of every group that ``limits`` lists, best first by score, then by smaller item.

    Returns group, item, score and ``rank`` (1 is the best).

    Stage one ranks inside (group, salt of item) and keeps the largest limit of the table; stage two joins
    each group's own limit and ranks the survivors, at most ``salts`` times that many in a group. Spark cuts
    both windows to the limit before it shuffles, so a group with a third of all rows reaches no single task.

    Nulls and NaN: see ``best_scores``. A group listed repeatedly has its largest limit; null limits and those
    under 1 list nothing. Ties and repeated rows are settled by the item. Groups without candidates give no
    row; empty tables give an empty result. Other columns are ignored, whatever their names.
    """
    listed = limits.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(limit).cast("bigint").alias("__limit")).where("__limit > 0")
    most = listed.agg(F.max("__limit")).first()[0] or 0
    salt, first = "__salt", "__first"
    best_first: list[Column] = [F.col(score).desc(), F.col(item).asc()]
    scored = best_scores(candidates.select(group, item, score), group, item, score).withColumn(salt, salt_of([item], salts))
    survivors = scored.withColumn(first, F.row_number().over(Window.partitionBy(group, salt).orderBy(*best_first))).where(F.col(first) <= F.lit(int(most))).drop(salt, first)
    ranked = survivors.join(listed, group).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*best_first)))
    return ranked.where((F.col("rank") <= F.lit(int(most))) & (F.col("rank") <= F.col("__limit"))).select(group, item, score, "rank")


def p2_found(spark, d: str) -> DataFrame:
    """The best documents of each listed question: question_id, doc_id."""
    candidates, cases = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("retrieval_candidate", "conflict_case"))
    return top_n_per_group(candidates, cases, "question_id", "doc_id", "score", "maximum_documents").select("question_id", "doc_id")


def p2_ranked(spark, d: str) -> DataFrame:
    """As p2_found, with the score and the rank of each document."""
    candidates, cases = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("retrieval_candidate", "conflict_case"))
    return top_n_per_group(candidates, cases, "question_id", "doc_id", "score", "maximum_documents")


QUERIES = {"p2_found": p2_found, "p2_ranked": p2_ranked}

_RANKED = """
WITH listed AS (
  SELECT question_id, max(maximum_documents) AS n FROM conflict_case
  WHERE question_id IS NOT NULL GROUP BY question_id HAVING max(maximum_documents) > 0),
best AS (
  SELECT question_id, doc_id, max(score) AS score FROM retrieval_candidate
  WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY question_id, doc_id),
ranked AS (
  SELECT question_id, doc_id, score, n, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
  FROM best JOIN listed USING (question_id))
"""
SQL = {
    "p2_found": _RANKED + "SELECT question_id, doc_id FROM ranked WHERE rank <= n",
    "p2_ranked": _RANKED + "SELECT question_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= n",
}
