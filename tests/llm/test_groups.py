"""Top N, grouping, percentiles and survivors."""

import math
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from tessella.llm import grouping, quantiles, survivors, topn


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CANDIDATES = "q string, d bigint, s double, __salt string, rank int"


def test_top_n_ties_repeats_nulls_and_other_columns(spark):
    c = spark.createDataFrame([("a", 3, 0.5, "x", 1), ("a", 1, 0.5, "x", 1), ("a", 2, 0.9, "x", 1), ("a", 2, 0.1, None, 9), ("a", 4, math.nan, "x", 1), ("a", 5, None, "x", 1), ("a", None, 9.0, "x", 1), (None, 7, 9.0, "x", 1), ("b", 1, -1.0, "x", 1), ("z", 1, 1.0, "x", 1)], CANDIDATES)
    n = spark.createDataFrame([("a", 2), ("a", 2), ("b", 5), ("c", 3), ("d", None), ("e", 0)], "q string, n bigint")
    got = topn.top_n_per_group(c, n, "q", "d", "s", "n", salts=3)
    assert rows(got) == [("a", 1, 0.5, 2), ("a", 2, 0.9, 1), ("b", 1, -1.0, 1)]


def test_top_n_of_empty_tables(spark):
    c, n = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([("a", 2)], "q string, n bigint")
    assert rows(topn.top_n_per_group(c, n, "q", "d", "s", "n")) == []
    assert rows(topn.top_n_per_group(spark.createDataFrame([("a", 1, 1.0, "", 1)], CANDIDATES), n.where("false"), "q", "d", "s", "n")) == []


def test_top_n_is_brute_force_for_any_salts_and_a_hot_group(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.5 else f"g{r.randrange(9)}", r.randrange(200), r.choice([0.1, 0.2, 0.5, 0.7])) for _ in range(3000)]
    limits = {f"g{i}": i for i in range(9)} | {"hot": 20}
    c = spark.createDataFrame(data, "q string, d bigint, s double")
    n = spark.createDataFrame(list(limits.items()), "q string, n bigint")
    best = {}
    for q, d, s in data:
        best.setdefault(q, {})
        best[q][d] = max(s, best[q].get(d, -1))
    want = sorted((q, d) for q, k in limits.items() for d, _ in sorted(best.get(q, {}).items(), key=lambda x: (-x[1], x[0]))[:k])
    for salts in (1, 7, 64):
        assert sorted(tuple(x)[:2] for x in topn.top_n_per_group(c, n, "q", "d", "s", "n", salts=salts).collect()) == want


def components(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_grouping_is_union_find(spark, kind):
    r = random.Random(2)
    pairs = {"chain": [(f"{i:03}", f"{i + 1:03}") for i in range(120)], "star": [("zz", f"{i:03}") for i in range(200)], "random": [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(220)], "loops": [("a", "a"), ("b", "a"), ("a", "b"), ("b", "a"), ("c", "d")]}[kind]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, "q", "x"), ("q", None, "x")], "a string, b string, member string")
    assert rows(grouping.consolidate(df, "a", "b")) == components(pairs)


def test_grouping_without_pairs(spark):
    assert rows(grouping.consolidate(spark.createDataFrame([], "a string, b string"), "a", "b")) == []


def test_accepted_pairs_leave_out_malformed_rows(spark):
    ids = [["A", "b "], ["b", "a"], ["a", "a"], ["a"], [], None, ["a", None], ["a", ""], ["a", "b", "c"], ["c", "d"], ["e", "f"]]
    status = ["accepted"] * 9 + [" Accepted\t", "rejected"]
    df = spark.createDataFrame(list(zip(ids, status, strict=True)), "candidate_source_object_ids array<string>, status string")
    assert rows(grouping.accepted_pairs(df)) == [("a", "b"), ("c", "d")]


def exact(values, percent):
    v = sorted(values)
    return v[max(0, -(-len(v) * percent // 100) - 1)]


def test_percentiles_keep_their_error_and_add_up(spark):
    r = random.Random(3)
    data = [(r.choice("ab"), r.randrange(4), r.choice([1, -1]) * 10 ** r.uniform(-4, 6)) for _ in range(4000)] + [("a", 0, 0.0), ("a", 1, 1e300), ("b", 1, -1e-300)]
    bad = [("a", 0, None), ("a", 0, math.nan), ("b", 0, math.inf), ("c", 0, None)]
    df = spark.createDataFrame(data + bad, "k string, day int, x double")
    days = [quantiles.bucket_counts(df.where(F.col("day") == i), ["k"], "x") for i in range(4)]
    merged = quantiles.percentiles(quantiles.merge_counts(*days, keys=["k"]), ["k"], (1, 50, 95, 99, 100))
    whole = quantiles.percentiles(quantiles.bucket_counts(df, ["k"], "x"), ["k"], (1, 50, 95, 99, 100))
    assert rows(merged) == rows(whole)
    for k, n, *found in rows(whole):
        values = [x for a, _, x in data if a == k]
        assert n == len(values)
        for p, got in zip((1, 50, 95, 99, 100), found, strict=True):
            want = exact(values, p)
            assert abs(got - want) <= quantiles.RELATIVE_ERROR * abs(want) * 1.000001


def test_percentiles_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(None, 5.0)], "k string, x double")
    (k, n, p50), *_ = rows(quantiles.percentiles(quantiles.bucket_counts(one, ["k"], "x"), ["k"], (50,)))
    assert k is None and n == 1 and abs(p50 - 5) <= 0.05
    assert rows(quantiles.percentiles(quantiles.bucket_counts(one.where("false"), ["k"], "x"), ["k"])) == []


def test_percentile_query_counts_every_run_and_has_a_row_a_key(spark, tmp_path):
    r = random.Random(4)
    first = datetime(2026, 1, 1, tzinfo=timezone.utc)
    runs = [(i, r.choice([" A", "a", "b-c", "B_C", None]), r.randrange(3), r.choice([1, -1]) * 10 ** r.uniform(-2, 5), 0) for i in range(400)]
    runs += [(i, arm, day, x, 1) for (i, arm, day, _, _), x in zip(runs[:60], [None, math.nan, math.inf, 0.0, 7.0] * 12, strict=True)]

    def found(name, copies, days):
        """The grains' numbers of rows and sums of n, for copies of the runs with ids and days moved on; equal to the SQL's rows."""
        d = tmp_path / name
        data = [(c * 400 + i, arm, (first + timedelta(day + c * days)).date(), x, first + timedelta(at)) for c in range(copies) for i, arm, day, x, at in runs]
        spark.createDataFrame(data, "row_id bigint, arm_id string, run_day date, latency_ms double, loaded_at timestamp").write.parquet(str(d / "causal_score_row.parquet"))
        df = quantiles.p5_percentiles(spark, str(d))
        db = duckdb.connect()
        db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW causal_score_row AS SELECT * FROM '{d}/causal_score_row.parquet/*.parquet'")
        sql = db.execute(quantiles.SQL["p5_percentiles"])
        ours = df.collect()
        assert oracle.rows(df.columns, ours) == oracle.rows([c[0] for c in sql.description], sql.fetchall())
        of = lambda grain: [row["n"] for row in ours if row["grain"] == grain]
        return {grain: (len(of(grain)), sum(of(grain))) for grain in ("arm_day", "arm", "day", "all")}

    # 36 of the 400 have no number in the load that counts
    assert found("once", 1, 0) == {"arm_day": (9, 364), "arm": (3, 364), "day": (3, 364), "all": (1, 364)}
    assert found("more_runs", 10, 0) == {"arm_day": (9, 3640), "arm": (3, 3640), "day": (3, 3640), "all": (1, 3640)}
    assert found("more_days", 10, 3) == {"arm_day": (90, 3640), "arm": (3, 3640), "day": (30, 3640), "all": (1, 3640)}


def test_best_of_group_and_of_fields(spark):
    df = spark.createDataFrame([("g", 1, "n/a", 3), ("g", 2, "x", None), ("g", 3, "y", 5), (None, 4, " ", 1), ("h", 5, None, None)], "g string, id int, v string, n int")
    assert [r["id"] for r in survivors.best_of_group(df, ["g"], [F.col("n").desc_nulls_last(), F.col("id")]).orderBy("id").collect()] == [3, 4, 5]
    assert rows(survivors.best_fields(df, ["g"], ["v", "n"], [F.col("id")])) == [("g", "x", 3), ("h", None, None), (None, None, 1)]


def test_real_values_and_times(spark):
    df = spark.createDataFrame([(v, t) for v, t in [("TBD ", "2025-01-02"), ("—", "2025-01-02T00:00:00+02:00"), ("0", "2025-01-02 01:00:00.5"), (None, "yesterday"), ("\xa0", "0000-00-00"), ("none left", None)]], "v string, t string")
    got = df.select(survivors.is_real(F.col("v")).alias("r"), survivors.instant(F.col("t")).cast("string").alias("t")).collect()
    assert [r["r"] for r in got] == [False, False, True, False, False, True]
    assert [r["t"] for r in got] == ["2025-01-02 00:00:00", "2025-01-01 22:00:00", "2025-01-02 01:00:00.5", None, None, None]


def test_claims_rank_by_priority_time_and_id(spark):
    members = spark.createDataFrame([("g", "s1"), ("g", "s2")], "group_id string, source_object_id string")
    policies = spark.createDataFrame([("owner_team", "jira", 2.0), ("owner_team", "JIRA ", 5.0), ("owner_team", "slack", None), ("region", "x", float("nan"))], "predicate string, source_system string, priority double")
    c = [("c1", "s1", "OwnerTeam", "A", "slack", "2026-01-01"), ("c2", "s2", "owner team", "B", "jira", None), ("c3", "s2", "owner-team", "tbd", "jira", "2026-01-01"), ("c4", "s1", " region", "Z", "x", "bad"), ("c5", "s2", "REGION", "Z", "y", "2025-01-01"), ("c6", "s3", "region", "Z", "y", "2025-01-01"), ("c7", "s1", "own", "V", "y", None)]
    claims = spark.createDataFrame(c, "claim_id string, source_object_id string, predicate string, object_value string, source_system string, observed_at string")
    every = survivors.ranked_claims(claims, members, policies)
    best = survivors.best_of_group(every, ["group_id", "predicate"], [F.col("priority").desc_nulls_last(), F.col("observed").desc_nulls_last(), F.col("claim_id").asc()])
    assert rows(best.select("predicate", "claim_id")) == [("own", "c7"), ("owner_team", "c2"), ("region", "c5")]
