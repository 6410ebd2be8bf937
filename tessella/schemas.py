"""Explicit schemas of records that come as JSON."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


DOCUMENT = _strings("doc_id", "source_type", "title", "content")
EMPLOYEE = _strings("employee_id", "name", "role", "location", "org")
CUSTOMER = _strings("id", "name", "role", "company")
