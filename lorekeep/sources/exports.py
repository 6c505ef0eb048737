"""Exports of conversations: files of one JSON object or of an array of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.conversation import EXPORT_SCHEMA


def read_export(spark: SparkSession, path: str, export: bool = True) -> DataFrame:
    """Conversations of the files; export: each file is an array.  A file that is no such JSON fails the read."""
    return decode_export(spark.read.text(path, wholetext=True), export)


def decode_export(texts: DataFrame, export: bool = True) -> DataFrame:
    """The same of texts (value)."""
    if export:
        return texts.select(F.explode(F.from_json("value", f"ARRAY<STRUCT<{_nested(EXPORT_SCHEMA)}>>", {"mode": "FAILFAST"})).alias("c")).select("c.*")
    return texts.select(F.from_json("value", EXPORT_SCHEMA, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def _nested(schema: str) -> str:
    """The schema's top fields in the form of a struct's."""
    out, depth, field = [], 0, ""
    for char in schema:
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and not depth:
            out.append(field.strip())
            field = ""
        else:
            field += char
    out.append(field.strip())
    return ", ".join(f"{f.split(None, 1)[0]}: {f.split(None, 1)[1]}" for f in out)
