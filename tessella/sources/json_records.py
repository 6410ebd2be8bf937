"""Records out of JSON files, with every line that can't be one kept as a reject."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.ids import canonical_json, stable_id
from tessella.schemas import CUSTOMER, DOCUMENT, EMPLOYEE

Parts = tuple[DataFrame, DataFrame, DataFrame]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1, within its file), raw of every line that isn't blank.

    A line's number needs the lines before it, so each file is read by one task: give a large corpus as many files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    each = whole.select("path", F.posexplode(F.split("value", r"\r\n|\n")).alias("i", "raw"))
    return each.where(F.trim("raw") != "").select("path", (F.col("i") + 1).cast("bigint").alias("line"), "raw")


def read_lines(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, required: tuple[str, ...] = ("doc_id", "source_type", "content"), system: str = "source_type") -> Parts:
    """records, rejects and coverage of JSON lines that must have exactly the schema's keys.

    A reject is ``invalid_json`` or ``invalid_shape``, with a stable id; coverage is partial for all systems if there is any.
    """
    keys = F.array_sort(F.json_object_keys("raw"))
    wanted = F.array(*(F.lit(f) for f in sorted(schema.names)))
    parsed = _lines(spark, path).withColumn("r", F.from_json("raw", schema)).withColumn("json", F.try_parse_json("raw").isNotNull())
    filled = [F.length(F.col(f"r.{c}")) > 0 for c in required]
    shaped = (keys == wanted) & filled[0]
    for f in filled[1:]:
        shaped = shaped & f
    reason = F.when(~F.col("json"), "invalid_json").when(~F.coalesce(shaped, F.lit(False)), "invalid_shape")
    judged = parsed.withColumn("reason", reason)
    records = judged.where("reason IS NULL").select("path", "line", "r.*", F.sha2("raw", 256).alias("digest"))
    where = canonical_json({"line": F.col("line").cast("string"), "path": F.col("path")})
    rejects = judged.where("reason IS NOT NULL").select(stable_id("reject", where).alias("reject_id"), "path", "line", "reason", "raw")
    from tessella.operators.intake import coverage

    return records, rejects, coverage(records, rejects, system)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path, value of each file, empty ones too; a file is one value, so it has to fit a task and 2 GB.

    Spark's readers skip empty files, so those are added from the listing.
    """
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    empty = [(x.getPath().toString(), "") for x in fs.listStatus(root) if x.isFile() and x.getLen() == 0]
    return read.unionByName(spark.createDataFrame(empty, "path string, value string")) if empty else read


def read_keyed_object(spark: SparkSession, path: str, schema: T.StructType = EMPLOYEE, key: str = "employee_id") -> tuple[DataFrame, DataFrame]:
    """records and rejects of files that hold one JSON object each, from key to record; a key must be its record's own.

    A file that isn't a JSON object is one reject (``invalid_json``, null key), and so is each record that is null or no object.
    """
    parsed = _whole(spark, path).select("path", F.from_json("value", "map<string,string>").alias("m"), (F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).alias("fine"))
    fine = F.coalesce("fine", F.lit(False)) & F.col("m").isNotNull()
    each = parsed.where(fine).select("path", F.explode("m").alias("key", "x")).withColumn("r", F.from_json("x", schema))
    own = F.coalesce(F.col("key") == F.col(f"r.{key}"), F.lit(False))
    broken = parsed.where(~fine).select("path", F.lit(None).cast("string").alias("key"), F.lit("invalid_json").alias("reason"))
    return each.where(own).select("path", "r.*"), each.where(~own).select("path", "key", F.lit("invalid_shape").alias("reason")).unionByName(broken)


def read_array(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER, required: tuple[str, ...] = ("id", "name")) -> tuple[DataFrame, DataFrame]:
    """records and rejects (by index) of files that hold one JSON array each; a file that isn't one is a reject with a null index."""
    parsed = _whole(spark, path).select("path", F.from_json("value", "array<string>").alias("a"), (F.try_parse_json("value").isNotNull() & F.trim("value").startswith("[")).alias("fine"))
    good = F.coalesce("fine", F.lit(False)) & F.col("a").isNotNull()
    each = parsed.where(good).select("path", F.posexplode("a").alias("index", "x")).withColumn("r", F.from_json("x", schema))  # element by element: a bad one doesn't take the others along
    fine = F.coalesce(sum(((F.length(F.col(f"r.{c}")) > 0).cast("int") for c in required), F.lit(0)) == len(required), F.lit(False))
    broken = parsed.where(~good).select("path", F.lit(None).cast("int").alias("index"), F.lit("invalid_json").alias("reason"))
    return each.where(fine).select("path", "index", "r.*"), each.where(~fine).select("path", "index", F.lit("invalid_shape").alias("reason")).unionByName(broken)


_PRODUCT = "path string, product string, team_ids array<string>, customer_ids array<string>, lengths map<string,bigint>, authors map<string,bigint>, reason string"


def read_products(spark: SparkSession, path: str, team: str = "team", customers: str = "customers", author: str = "userId") -> tuple[DataFrame, DataFrame]:
    """products and rejects of a directory of JSON files, one product each, named by its file.

    product, team_ids and customer_ids (strings, what isn't one is left out), lengths (how long each list of the product is),
    authors (how often each string stands under ``author`` at any depth). A file that isn't an object is a reject.
    """

    def parse(batches):
        for b in batches:
            rows = []
            for p, text in zip(b["path"], b["value"], strict=True):
                name = p.rsplit("/", 1)[-1].removesuffix(".json")
                try:
                    v = json.loads(text)
                except ValueError:
                    v = None
                if not isinstance(v, dict):
                    rows.append((p, name, None, None, None, None, "invalid_json" if v is None else "invalid_shape"))
                    continue
                ids = lambda k, v=v: [i for i in v.get(k, []) if isinstance(i, str)] if isinstance(v.get(k), list) else []
                found: dict[str, int] = {}
                for a in _found(v, author, []):
                    found[a] = found.get(a, 0) + 1
                rows.append((p, name, ids(team), ids(customers), {k: len(x) for k, x in v.items() if isinstance(x, list)}, found, None))
            yield pd.DataFrame(rows, columns=["path", "product", "team_ids", "customer_ids", "lengths", "authors", "reason"])

    read = _whole(spark, path).mapInPandas(parse, _PRODUCT)
    return read.where("reason IS NULL").drop("reason"), read.where("reason IS NOT NULL").select("path", "product", "reason")


def message_authors(products: DataFrame) -> DataFrame:
    """product, handle, messages, external_id: who wrote in a product; only handles of the form of a person's id are an external id too."""
    each = products.select("product", F.explode("authors").alias("handle", "messages"))
    return each.withColumn("external_id", F.when(F.col("handle").rlike("^eid_[a-f0-9]+$"), F.col("handle")))


def read_people(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """records and rejects by object type of a path: employees alone of a file; of a directory employees, customers and products."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(root).isFile():
        return {"employee": read_keyed_object(spark, path)}
    base = path.rstrip("/")
    return {"employee": read_keyed_object(spark, f"{base}/employees.json"), "customer": read_array(spark, f"{base}/customers.json"), "product": read_products(spark, f"{base}/products")}


def write_artifact(df: DataFrame, path: str, order: list[str]) -> None:
    """Writes a report as JSON lines in the order of columns that tell its rows apart; nulls are kept."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def nested_reports(spark: SparkSession, path: str, key: str = "employee_id") -> DataFrame:
    """path, id, report of each JSON object with a string under ``key`` and each other one nested in it at any depth; an id isn't its own report."""

    def run(batches):
        for b in batches:
            rows = []

            def visit(v, above, p, rows=rows):
                if isinstance(v, dict):
                    own = v.get(key)
                    if isinstance(own, str):
                        rows.extend((p, a, own) for a in above if a != own)
                        above = (*above, own)
                    for x in v.values():
                        visit(x, above, p)
                elif isinstance(v, list):
                    for x in v:
                        visit(x, above, p)

            for p, text in zip(b["path"], b["value"], strict=True):
                try:
                    visit(json.loads(text), (), p)
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "id", "report"])

    return _whole(spark, path).mapInPandas(run, "path string, id string, report string").distinct()


def _found(value, key: str, out: list[str]) -> list[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            if k == key and isinstance(v, str):
                out.append(v)
            _found(v, key, out)
    elif isinstance(value, list):
        for v in value:
            _found(v, key, out)
    return out


def nested_values(spark: SparkSession, path: str, key: str) -> DataFrame:
    """path, value, n: the strings under a key at any depth of each JSON file, and how often. Files that aren't JSON have none."""

    def values(batches):
        for b in batches:
            found = []
            for text in b["value"]:
                try:
                    found.append(_found(json.loads(text), key, []))
                except ValueError:
                    found.append([])
            yield b[["path"]].assign(values=found)

    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return read.mapInPandas(values, "path string, values array<string>").select("path", F.explode("values").alias("value")).groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))


def read_or_fail(read, spark: SparkSession, path: str) -> Parts:
    """``read(spark, path)``, or, where the path can't be read, no records, one reject and one failed coverage."""
    try:
        return read(spark, path)
    except AnalysisException:  # what parses wrongly is a reject of its line or file, not an exception
        none = spark.createDataFrame([], DOCUMENT)
        return none, spark.createDataFrame([(path, "unsupported_input")], "path string, reason string"), spark.createDataFrame([(path, 0, "failed")], "source_type string, objects bigint, status string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a path: a manifest, and what to verify one with."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
