"""Files in, graph out, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import json_records as J
from tessella.sources.graph_store import GraphStore
from tessella.streaming import intake as S


def test_lines_records_rejects_and_coverage(spark, tmp_path):
    good = {"doc_id": "d1", "source_type": "jira", "title": "t", "content": "c"}
    lines = [json.dumps(good), json.dumps(good), "", "{broken", json.dumps(good | {"more": 1}), json.dumps(good | {"content": ""}), json.dumps({"doc_id": "d2"})]
    (tmp_path / "x.jsonl").write_text("\r\n".join(lines))
    records, rejects, coverage = J.read_lines(spark, str(tmp_path / "x.jsonl"))
    assert [r["line"] for r in records.orderBy("line").collect()] == [1, 2] and records.select("digest").distinct().count() == 1
    found = [(r["line"], r["reason"]) for r in rejects.orderBy("line").collect()]
    assert found == [(4, "invalid_json"), (5, "invalid_shape"), (6, "invalid_shape"), (7, "invalid_shape")]
    assert [tuple(r) for r in coverage.collect()] == [("jira", 2, "partial")]
    again = J.read_lines(spark, str(tmp_path / "x.jsonl"))[1]
    assert rejects.select("reject_id").exceptAll(again.select("reject_id")).count() == 0


def test_objects_arrays_and_nested_values(spark, tmp_path):
    e = {"employee_id": "e1", "name": "n", "role": "r", "location": "l", "org": "o"}
    (tmp_path / "e.json").write_text(json.dumps({"e1": e, "e2": e}))
    records, rejects = J.read_keyed_object(spark, str(tmp_path / "e.json"))
    assert [r["employee_id"] for r in records.collect()] == ["e1"] and [r["key"] for r in rejects.collect()] == ["e2"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "name": "a", "role": None, "company": "c"}, {"id": "2"}, None]))
    records, rejects = J.read_array(spark, str(tmp_path / "c.json"))
    assert [r["id"] for r in records.collect()] == ["1"] and sorted(r["index"] for r in rejects.collect()) == [1, 2]
    (tmp_path / "n.json").write_text(json.dumps({"userId": "u1", "x": [{"userId": "u2"}, {"y": {"userId": "u2"}}, {"userId": 5}]}))
    assert sorted((r["value"], r["n"]) for r in J.nested_values(spark, str(tmp_path / "n.json"), "userId").collect()) == [("u1", 1), ("u2", 2)]
    assert J.file_digests(spark, str(tmp_path)).count() == 3


def test_broken_files_are_rejects(spark, tmp_path):
    e = {"employee_id": "e1", "name": "n", "role": "r", "location": "l", "org": "o"}
    for name, text in (("a", json.dumps({"e1": e, "e2": None})), ("b", "{broken"), ("c", "[1]"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    records, rejects = J.read_keyed_object(spark, str(tmp_path))
    assert records.count() == 1 and sorted((r["path"][-6:], r["key"], r["reason"]) for r in rejects.collect()) == [("a.json", "e2", "invalid_shape")] + [(f"{n}.json", None, "invalid_json") for n in "bcd"]
    records, rejects = J.read_array(spark, str(tmp_path))
    assert sorted((r["path"][-6:], r["index"], r["reason"]) for r in rejects.collect()) == [("a.json", None, "invalid_json"), ("b.json", None, "invalid_json"), ("c.json", 0, "invalid_shape"), ("d.json", None, "invalid_json")]


def test_products_authors_and_reports(spark, tmp_path):
    root = tmp_path / "herb"
    (root / "products").mkdir(parents=True)
    (root / "employees.json").write_text("{}")
    (root / "customers.json").write_text("[]")
    (root / "products" / "Alpha.json").write_text(json.dumps({"team": ["e1", 5, "e2"], "customers": "none", "slack": [{"userId": "eid_0a"}, {"replies": [{"userId": "eid_0a"}, {"userId": "bot"}]}]}))
    (root / "products" / "Bad.json").write_text("[]")
    people = J.read_people(spark, str(root))
    products, rejects = people["product"]
    row = products.first()
    assert (row["product"], row["team_ids"], row["customer_ids"], row["lengths"]) == ("Alpha", ["e1", "e2"], [], {"team": 3, "slack": 2})
    assert [(r["product"], r["reason"]) for r in rejects.collect()] == [("Bad", "invalid_shape")]
    assert sorted(tuple(r) for r in J.message_authors(products).collect()) == [("Alpha", "bot", 1, None), ("Alpha", "eid_0a", 2, "eid_0a")]
    assert set(J.read_people(spark, str(root / "employees.json"))) == {"employee"}
    (tmp_path / "team.json").write_text(json.dumps({"employee_id": "a", "reports": [{"employee_id": "b", "reports": [{"employee_id": "c"}, {"employee_id": "a"}]}]}))
    assert sorted((r["id"], r["report"]) for r in J.nested_reports(spark, str(tmp_path / "team.json")).collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]
    J.write_artifact(products.select("product", F.lit(None).cast("string").alias("x")), str(tmp_path / "out"), ["product"])
    assert [json.loads(x[0]) for x in spark.read.text(str(tmp_path / "out")).collect()] == [{"product": "Alpha", "x": None}]


def test_what_cannot_be_read_is_a_failed_coverage(spark, tmp_path):
    records, rejects, coverage = J.read_or_fail(J.read_lines, spark, str(tmp_path / "missing.jsonl"))
    assert records.count() == 0 and rejects.first()["reason"] == "unsupported_input" and coverage.first()["status"] == "failed"


NODE = "label string, id string, payload string"


def test_graph_writes_may_be_repeated(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    first = spark.createDataFrame([("Claim", "1", "a"), ("Claim", "2", "a")], NODE)
    assert store.missing(first).count() == 2
    store.upsert(first)
    store.upsert(first)
    store.upsert(spark.createDataFrame([("Claim", "2", "b"), ("Entity", "2", "c")], NODE))
    assert sorted(map(tuple, store.read().collect())) == [("Claim", "1", "a"), ("Claim", "2", "b"), ("Entity", "2", "c")] and store.missing(first).count() == 0
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("Other", "1", "a")], NODE))


def test_streams_upsert_new_files_once(spark, tmp_path):
    events = spark.createDataFrame([(1, "2025-01-01 00:10:00", 1, "a", 2.0, "{}"), (2, "2025-01-01 00:20:00", 1, "a", 3.0, "{}"), (2, "2025-01-01 00:20:00", 1, "a", 3.0, "{}"), (3, "2025-01-01 01:10:00", 2, "b", 1.0, "{}")], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    store = GraphStore(spark, f"file://{tmp_path}/g")
    for _ in range(2):
        q = S.ingest_available(spark, f"{tmp_path}/in/*", S.EVENTS, store, "Claim", "event_id", f"{tmp_path}/cp")
        q.awaitTermination(120)
    assert sorted(r["id"] for r in store.read().collect()) == ["1", "2", "3"]
    q = S.windowed_counts(spark.readStream.schema(S.EVENTS).parquet(f"{tmp_path}/in/*"), "ts", ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM w").collect()) == [("a", 2, 5.0), ("b", 1, 1.0)]
