"""Column expressions against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from tessella.functions import ids, text


def one(spark, value, *columns, kind="string"):
    return list(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_stable_ids_are_digests_of_canonical_json(spark):
    value = 'a"b\\ \n\x1fé/日本'
    got = one(spark, value, ids.stable_id("ns", ids.canonical_json({"z": F.col("x"), "a": F.lit(None).cast("string")})))[0]
    body = json.dumps({"a": None, "z": value}, ensure_ascii=False, separators=(",", ":"))
    assert got == "ns_" + hashlib.sha256(f"ns\0{body}".encode()).hexdigest()[:24]
    assert one(spark, "k", ids.int_id(F.col("x")))[0] == int(hashlib.sha256(b"k").hexdigest()[:13], 16)
    assert one(spark, "b", ids.pair_key(F.col("x"), F.lit("a")))[0] == one(spark, "a", ids.pair_key(F.col("x"), F.lit("b")))[0]


def test_samples_are_repeatable_and_even(spark):
    n = spark.range(20000).select(ids.hash_share(F.col("id").cast("string"), "s", 10).alias("h")).groupBy("h").count().collect()
    assert len(n) == 10 and all(1700 < r["count"] < 2300 for r in n)


def test_normal_forms(spark):
    x = F.col("x")
    assert one(spark, "  A\t b\n\nC ", text.collapsed(x)) == ["a b c"]
    assert one(spark, "ｆｕｌｌ ﬁ", text.nfkc(x)) == ["full fi"] and one(spark, None, text.nfkc(x)) == [None]
    assert one(spark, " OwnerTeam-name  X ", text.slug(x)) == ["owner_team_name_x"]
    assert one(spark, "v12", text.version_rank(x)) == [12] and one(spark, None, text.version_rank(x)) == [0]


def test_terms_and_anchors(spark):
    x = F.col("x")
    assert one(spark, "What is the Limit of the limits, I?", text.query_terms(x)) == [["limit", "limits"]]
    assert one(spark, "the of", text.query_terms(x)) == [["enterprise"]] and one(spark, None, text.query_terms(x)) == [["enterprise"]]
    assert [one(spark, w, text.singular(F.col("x")))[0] for w in ("policies", "limits", "pass", "gas")] == ["policy", "limit", "pass", "gas"]
    assert one(spark, "OPS-12 v1.2.3 OPS-12 f00dfeed", text.anchors(x)) == [["OPS-12", "v1.2.3", "f00dfeed"]]


def test_numbers_and_dates_in_text(spark):
    x = F.col("x")
    assert one(spark, "about 12.5 % now", text.percentage(x)) == [12.5] and one(spark, "1% and 2%", text.percentage(x)) == [None]
    assert str(one(spark, "2025-02-30 2025-01-02 2024-12-31", text.latest_date(x))[0]) == "2025-01-02" and one(spark, "none", text.latest_date(x)) == [None]


def test_facts_are_the_same_in_other_units(spark):
    df = spark.createDataFrame([("duration", 2.0, "min", None), ("duration", 120000.0, "MS", None), ("number", -0.0, None, None), ("number", 0.0, None, None), ("set", None, None, ["B ", "a", "b"]), ("set", None, None, ["b", "A"])], "k string, n double, u string, v array<string>")
    keys = [r[0] for r in df.select(text.fact_key(F.col("k"), F.col("n"), F.col("u"), F.col("v"))).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == keys[5] and len(set(keys)) == 3


def test_ratios(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 3)], "n int, d int")
    assert [r[0] for r in df.select(text.ratio(F.col("n"), F.col("d"))).collect()] == [0.5, None, 0.0]
    assert spark.range(1).select(text.f1(F.lit(0.0), F.lit(0.0)), text.f1(F.lit(1.0), F.lit(0.5))).first()[:2] == (0.0, 2 / 3)


def test_repairs_of_replies(spark):
    x = F.col("x")
    assert one(spark, '<think>{"a"}</think>```json\n{"a": [1,2,],}\n```', text.unwrapped_json(x)) == ['{"a": [1,2]}']
    assert one(spark, 'so: {"a":1} and {"b', text.complete_prefix(x)) == ['{"a":1}'] and one(spark, "none {", text.complete_prefix(x)) == [None] and one(spark, None, text.complete_prefix(x)) == [None]
    assert one(spark, " The  LIMIT\nis ５", text.quoted_in(F.lit("limit is 5"), x)) == [True] and one(spark, "a", text.quoted_in(F.lit(" "), x)) == [False] and one(spark, None, text.quoted_in(F.lit("a"), x)) == [False]
