"""Filling fixed-capacity containers with items, by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import count_tokens
from tessella.operators.ranking import rank_in_group
from tessella.staging import stage

SALTS = 64


def fill_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How many containers have which lengths: (containers, {length: how often in each}).

    Lengths, longest first, go one by one into the container with most space left, in a new one where none has
    enough; containers of the same content move together, so the work follows the number of lengths, at most
    ``capacity``, and not the number of items.
    """
    space: list[tuple[int, int]] = []  # (-space left, bundle)
    bundles: list[tuple[int, tuple | None]] = []  # containers, content as a chain of (length, copies, rest)
    add = lambda left, n, chain: (bundles.append((n, chain)), heapq.heappush(space, (-left, len(bundles) - 1)))
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit a capacity of {capacity}")
        todo = histogram[length]
        while todo and space and -space[0][0] >= length:
            left, k = heapq.heappop(space)
            left = -left
            n, chain = bundles[k]
            bundles[k] = (0, None)
            # all of the bundle takes as many rounds as leave it the one with most space
            below = -space[0][0] if space else -1
            rounds = min(todo // n, max(1, (left - max(below, length)) // length + 1), left // length) if todo >= n else 0
            if rounds:
                add(left - rounds * length, n, (length, rounds, chain))
                todo -= rounds * n
            else:
                add(left - length, todo, (length, 1, chain))
                add(left, n - todo, chain)
                todo = 0
        if todo:
            each = capacity // length
            if todo // each:
                add(capacity - each * length, todo // each, (length, each, None))
            if todo % each:
                add(capacity - todo % each * length, 1, (length, todo % each, None))
    patterns = []
    for n, chain in bundles:
        content: dict[int, int] = {}
        while n and chain:
            content[chain[0]] = content.get(chain[0], 0) + chain[1]
            chain = chain[2]
        if n:
            patterns.append((n, content))
    return patterns


def _segments(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, first container, copies in a container) by rank; ranks and containers from 0."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for n, content in patterns:
        for length, copies in content.items():
            rows.setdefault(length, []).append((used.get(length, 0), first, copies))
            used[length] = used.get(length, 0) + n * copies
        first += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(items: DataFrame, item: str, size: str, capacity: int, salts: int = SALTS) -> DataFrame:
    """Assigns every item, or each part of one larger than ``capacity``, to a container.

    Returns item, ``piece`` (0, 1, ...; parts of a split item have ``capacity`` but for the last), ``tokens`` (of the piece),
    ``start`` (of the piece in its item) and ``container_id`` (from 0).

    Only the histogram of sizes, at most ``capacity`` rows, comes to the driver, and only the segments of
    ranks that share a pattern go out, both independent of the number of items. Items meet their pattern by
    their rank among those of one length, ranked in salted runs. ``items`` is read twice: give it staged.

    An item of size 0 or null takes no space and has no container (null). Items that repeat each count.
    """
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(whole / F.lit(capacity))).cast("int")
    pieces = items.select(F.col(item), whole.alias("__size"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * F.lit(capacity)
    pieces = pieces.select(item, "piece", F.least(F.lit(capacity), F.col("__size") - start).cast("bigint").alias("tokens"), start.alias("start"))
    histogram = {r["tokens"]: r["n"] for r in pieces.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = items.sparkSession.sparkContext.broadcast(_segments(fill_patterns(histogram, capacity)))
    ranked = rank_in_group(pieces.where("tokens > 0"), ["tokens"], [item, "piece"], salts)
    columns = [item, "piece", "tokens", "start"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.empty(len(b), dtype=np.int64)
            tokens, ranks = b["tokens"].to_numpy(), b["rank"].to_numpy() - 1
            order = np.argsort(tokens, kind="stable")
            lengths, starts = np.unique(tokens[order], return_index=True)
            for length, own in zip(lengths, np.split(order, starts[1:]), strict=True):
                s = segments.value[int(length)]
                k = np.searchsorted(s[:, 0], ranks[own], side="right") - 1
                found[own] = s[k, 1] + (ranks[own] - s[k, 0]) // s[k, 2]
            yield b[columns].assign(container_id=found)

    kinds = dict(ranked.dtypes)
    placed = ranked.mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", container_id bigint")
    return placed.unionByName(pieces.where("tokens <= 0").withColumn("container_id", F.lit(None).cast("bigint")))


def _packed(spark, d: str) -> DataFrame:
    sizes = stage(count_tokens(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"], "text"), "sizes")
    every = None
    # the budgets are a table of fixed size
    for r in spark.read.parquet(f"{d}/context_budget.parquet").where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().orderBy("budget_id", "capacity_tokens").collect():
        one = pack(sizes, "doc_id", "tokens", r["capacity_tokens"]).select(F.lit(r["budget_id"]).alias("budget_id"), F.lit(r["capacity_tokens"]).alias("capacity_tokens"), "*")
        every = one if every is None else every.unionByName(one)
    return every if every is not None else spark.createDataFrame([], "budget_id bigint, capacity_tokens bigint, doc_id bigint, piece int, tokens bigint, start bigint, container_id bigint")


def p9_packed(spark, d: str) -> DataFrame:
    """Every document's contexts for each budget: budget_id, capacity_tokens, doc_id, piece, tokens, start, container_id."""
    return _packed(spark, d)


def p9_fill(spark, d: str) -> DataFrame:
    """How full the contexts are: budget_id, capacity_tokens, containers, tokens, fill, fewest_possible."""
    packed = _packed(spark, d).where("container_id IS NOT NULL")
    by_container = packed.groupBy("budget_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"))
    n, total = F.count(F.lit(1)), F.sum("tokens")
    return by_container.groupBy("budget_id", "capacity_tokens").agg(n.alias("containers"), total.alias("tokens"), F.round(total / (n * F.col("capacity_tokens")), 6).alias("fill"), F.ceil(total / F.col("capacity_tokens")).cast("bigint").alias("fewest_possible"))


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
