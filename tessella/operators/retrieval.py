"""Lexical retrieval: postings, BM25, diverse ranking, anchors and text spans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import query_terms, words
from tessella.staging import stage

#: The usual parameters of BM25.
K1, B = 1.2, 0.75
#: Documents that are scored at once, and queries whose terms meet them in one task.
DOCUMENTS, QUERIES = 32_768, 65_536
#: What two scores of one rounded value may differ by.
SLACK = 2e-6


def postings(documents: DataFrame, item: str, texts: list[str], wanted: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """item, term, tf, length of every term of the concatenated texts, and of each of ``more`` once a document; of ``wanted`` (term) alone, if given, before anything is shuffled."""
    terms = F.concat("w", F.array(*map(F.lit, more))) if more else F.col("w")
    every = documents.select(item, words(F.concat_ws(" ", *texts)).alias("w")).select(item, F.size("w").cast("bigint").alias("length"), F.explode(terms).alias("term"))
    if wanted is not None:
        every = every.join(F.broadcast(wanted), "term", "left_semi")
    return every.groupBy(item, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, query: str, terms: Column, documents: DataFrame, item: str, texts: list[str], k: int) -> DataFrame:
    """query, item, score, place: the ``k`` best documents of each query.

    Only the postings of terms that some query has leave their task, and are kept as a table. Scores are summed where a chunk of the documents
    meets the queries (``best_sums``).
    """
    asked = queries.select(query, F.explode(terms).alias("term")).distinct()
    # Texts are read once: a row of the empty term, which no text has, counts each document and its words.
    every = documents.sparkSession.range(1).select(F.lit("").alias("term"))
    kept = stage(postings(documents, item, texts, asked.select("term").distinct().unionByName(every), ("",)), "postings")
    lengths = stage(kept.where("term = ''").agg(F.sum("tf").alias("docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean")), "lengths")
    found = kept.where("term <> ''")
    often = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = asked.join(often, "term").crossJoin(F.broadcast(lengths)).select(query, "term", idf.alias("factor"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scores = best_sums(found.crossJoin(F.broadcast(lengths)).select(item, "term", part.alias("weight")), weighted, query, item, (), k, SLACK)
    return ranked(scores.withColumn("score", F.round("score", 6)), query, item, "score", k)


def best_sums(found: DataFrame, asked: DataFrame, query: str, item: str, keep: tuple[str, ...], k: int, slack: float = 0.0) -> DataFrame:
    """query, item, ``keep``, score: of each query and ``keep`` the ``k`` items of the greatest sums and more, equal sums by item.

    found: item, ``keep``, term, weight. asked: query, term, factor, the same factor wherever a term is; each pair once. All weights and factors are above 0.
    An item's score is the sum of factor and weight over the terms that it shares with the query. With ``slack`` also those are given whose score is less by
    that much at most than the ``k``-th. Chunks of the items meet blocks of the queries, and of each meeting only its best leave their task: no row is
    made for a query and an item that share a word.
    """
    spark = found.sparkSession
    n, q = found.agg(F.approx_count_distinct(item)).first()[0], asked.agg(F.approx_count_distinct(query)).first()[0]
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = min(DOCUMENTS, max(2_048, -(-8 * n // (3 * tasks))))
    blocks = max(-(-q // QUERIES), -(-tasks * size // max(n, 1)) if q * n > 1 << 20 else 1)
    count = F.ceil(F.approx_count_distinct(item) / size).cast("int").alias("__chunks")
    sizes = stage(found.groupBy(*keep).agg(count).select(*(F.col(c).alias(f"__{c}") for c in keep), F.greatest("__chunks", F.lit(1)).alias("__chunks")), "sizes")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keep]
    chunked = (found.join(sizes, same) if keep else found.crossJoin(F.broadcast(sizes))).withColumn("__chunk", F.pmod(F.xxhash64(item), F.col("__chunks")).cast("int"))
    keys = [*keep, "__chunk", "__block"]
    left = chunked.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*keys, item, "term", "weight")
    every = sizes.select(*(F.col(f"__{c}").alias(c) for c in keep), F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
    right = asked.withColumn("__block", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int")).crossJoin(F.broadcast(every)).select(*keys, query, "term", "factor")
    kinds = dict(found.dtypes) | dict(asked.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (query, item, *keep)), "score double"])
    parts = 2 * blocks * max(1, -(-n // size))  # a number of its own, so that small parts with much to do aren't put together
    met = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys))
    return met.applyInArrow(_best_of_chunk(query, item, keep, k, slack), schema)


def _best_of_chunk(query: str, item: str, keep: tuple[str, ...], k: int, slack: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one chunk of items and one block of queries the best items of each query, as ``best_sums`` gives them."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        items, terms = left[item].combine_chunks(), pc.dictionary_encode(left["term"].combine_chunks())
        asks = pc.dictionary_encode(right[query].combine_chunks())
        term = pc.index_in(right["term"].combine_chunks(), value_set=terms.dictionary) if len(left) else pa.nulls(len(right), pa.int32())
        known = np.flatnonzero(np.asarray(pc.is_valid(term)))
        picked_q, picked_d, picked_s, first = [], [], [], np.zeros(0, "int64")
        if len(known):
            t, q = term.take(pa.array(known)).to_numpy().astype("int64"), asks.indices.take(pa.array(known)).to_numpy().astype("int64")
            place = pc.rank(items, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype("int64") - 1
            _, first = np.unique(place, return_index=True)  # items in order: a smaller place is a smaller item
            n = len(first)
            factor = np.zeros(len(terms.dictionary))
            factor[t] = right["factor"].to_numpy()[known]
            code = terms.indices.to_numpy().astype("int64")
            pair, at = np.unique(code * n + place, return_inverse=True)
            weight = np.bincount(at, left["weight"].to_numpy() * factor[code], len(pair))
            own, place = np.divmod(pair, n)
            start = np.searchsorted(own, np.arange(len(factor) + 1))
            often = np.diff(start)
            # Blocks of `fold` places: the k-th greatest of their maxima bounds the k-th best from below.
            fold = max(1, min(64, n // (4 * k)))
            padded = -(-n // fold) * fold
            columns: dict[int, np.ndarray] = {}

            def column(t: int) -> np.ndarray:
                if t not in columns:
                    columns[t] = np.zeros(padded)
                    columns[t][place[start[t] : start[t + 1]]] = weight[start[t] : start[t + 1]]
                return columns[t]

            # Queries with the same frequent terms follow each other, so the sums of these are made once.
            order = np.lexsort((t, -often[t], q))
            t, q = t[order], q[order]
            ends = np.flatnonzero(np.diff(q, append=-1)) + 1
            asked = sorted((t[a:b].tolist(), int(q[a])) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True))
            sums, path, tail = [np.zeros(padded)], [], np.zeros(padded)
            for own, one in asked:
                dense = [x for x in own if often[x] * 16 >= n]
                depth = 0
                while depth < min(len(path), len(dense)) and path[depth] == dense[depth]:
                    depth += 1
                path = dense
                for i in range(depth, len(dense)):
                    if len(sums) <= i + 1:
                        sums.append(np.zeros(padded))
                    np.add(sums[i], column(dense[i]), out=sums[i + 1])
                score = sums[len(dense)]
                if len(dense) < len(own):
                    np.copyto(tail, score)
                    for x in own[len(dense) :]:
                        tail[place[start[x] : start[x + 1]]] += weight[start[x] : start[x + 1]]
                    score = tail
                tops = score.reshape(fold, -1).max(axis=0)
                floor = np.partition(tops, len(tops) - k)[len(tops) - k] - slack if len(tops) > k else 0.0
                found = np.flatnonzero(score >= floor) if floor > 0 else np.flatnonzero(score > 0)
                s = score[found]
                if len(s) > k:
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    if slack:
                        kept = s >= kth - slack
                    else:
                        kept = s > kth
                        kept[np.flatnonzero(s == kth)[: k - np.count_nonzero(kept)]] = True
                    found, s = found[kept], s[kept]
                picked_q.append(np.full(len(found), one))
                picked_d.append(found)
                picked_s.append(s)
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        rows = joined(picked_q, "int64")
        out = {query: asks.dictionary.take(pa.array(rows)), item: items.take(pa.array(first[joined(picked_d, "int64")]))}
        out |= {c: pa.array([left[c][0].as_py()] * len(rows), left.schema.field(c).type) if len(rows) else pa.nulls(0, left.schema.field(c).type) for c in keep}
        return pa.table(out | {"score": pa.array(joined(picked_s, "float64"))})

    return best


def ranked(scores: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` best of each query with their place, equal scores by item."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item).asc()))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def diverse(scores: DataFrame, query: str, item: str, source: str, score: str, k: int) -> DataFrame:
    """``k`` of each query, the best of every source before any second: query, item, source, score, place."""
    order = [F.col(score).desc(), F.col(item).asc()]
    own = scores.withColumn("__own", F.row_number().over(Window.partitionBy(query, source).orderBy(*order))).where(F.col("__own") <= k)
    first = F.when(F.col("__own") == 1, 0).otherwise(1)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(first, *order))).where(F.col("place") <= k).drop("__own")


def term_points(queries: DataFrame, query: str, question: str, documents: DataFrame, item: str, title: str, body: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """query, term of the questions, and item, ``keep``, term, weight: of each of their terms 5 if the title has it and up to 3 for its count in the body.

    Title and body are read in one pass, and words that no question has end in their task.
    """
    asked = queries.select(query, F.explode(query_terms(F.col(question))).alias("term")).distinct()
    tagged = lambda column, t: F.transform(F.coalesce(words(F.col(column)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("term"), F.lit(t).alias("t")))
    every = documents.select(item, *keep, F.explode(F.concat(tagged(title, True), tagged(body, False))).alias("w")).select(item, *keep, "w.term", "w.t")
    counted = every.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy(item, *keep, "term").agg(F.bool_or("t").alias("t"), F.count_if(~F.col("t")).alias("b"))
    points = F.when(F.col("t"), 5).otherwise(0) + F.least(F.lit(3), F.col("b"))
    return asked, counted.select(item, *keep, "term", points.cast("bigint").alias("weight"))


def term_hits(queries: DataFrame, query: str, question: str, documents: DataFrame, item: str, title: str, body: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """query, item, ``keep``, score: the points of all documents that have a term of the question; ``best_hits`` has the best only, for less."""
    asked, points = term_points(queries, query, question, documents, item, title, body, keep)
    return points.join(asked, "term").groupBy(query, item, *keep).agg(F.sum("weight").alias("score"))


def best_hits(queries: DataFrame, query: str, question: str, documents: DataFrame, item: str, title: str, body: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of ``term_hits`` the ``k`` best of each query and ``keep``, equal scores by item, and some more."""
    asked, points = term_points(queries, query, question, documents, item, title, body, keep)
    placed = stage(points.withColumn("weight", F.col("weight").cast("double")), "points")
    return best_sums(placed, asked.withColumn("factor", F.lit(1.0)), query, item, keep, k).withColumn("score", F.col("score").cast("bigint"))


def contained(sets: DataFrame, key: str, member: str, found: DataFrame, query: str) -> DataFrame:
    """query, key of the sets that a query's finds hold wholly (relational division)."""
    distinct = sets.select(key, member).where(F.col(member).isNotNull()).distinct()
    sizes = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    hits = found.select(query, member).distinct().join(distinct, member).groupBy(query, key).agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, key).where("hits = size").select(query, key)


def segments(documents: DataFrame, item: str, text: str, widths: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """item, ``keep``, line, width, segment: each run of so many lines of a text that aren't blank. A row holds its own run only, never the whole text."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    each = documents.select(item, *keep, lines.alias("l"))
    run = lambda w: F.transform(F.col("l"), lambda x, i: F.struct(i.alias("line"), F.lit(w).alias("width"), F.array_join(F.slice("l", i + 1, F.lit(w)), "\n").alias("segment")))
    runs = F.concat(*(F.slice(run(w), F.lit(1), F.greatest(F.size("l") - (w - 1), F.lit(0))) for w in widths))
    return each.select(item, *keep, F.inline(runs))


def excerpt(text: Column, terms: Column, budget: int, most: int = 12) -> Column:
    """Of a text's lines those that have most of the terms, in their own order, as many as ``budget`` characters and ``most`` lines hold."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((-F.size(F.array_intersect(F.array_distinct(words(x)), terms))).alias("s"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(F.filter(lines, lambda x: x["s"] < 0)), 1, most)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<i:int,x:string>>").alias("k"))
    fits = F.aggregate(best, start, lambda a, x: F.when(a["n"] + F.length(x["x"]) <= budget, F.struct((a["n"] + F.length(x["x"])).alias("n"), F.concat(a["k"], F.array(F.struct(x["i"].alias("i"), x["x"].alias("x")))).alias("k"))).otherwise(a))
    return F.array_join(F.transform(F.array_sort(fits["k"]), lambda x: x["x"]), "\n")


def contrast_line(text: Column, terms: Column) -> Column:
    """The line that denies something and has most of the terms, the shortest of several; null without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?i)\b(not|no|never|without|cannot|can't|won't)\b"))
    scored = F.transform(lines, lambda x: F.struct((-F.size(F.array_intersect(F.array_distinct(words(x)), terms))).alias("s"), F.length(x).alias("n"), x.alias("x")))
    return F.try_element_at(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), F.lit(1))["x"]
