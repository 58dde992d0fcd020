"""Reading XML and JSON from files: whole documents, typed records, encodings by byte order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "array<struct<type:string,name:string,attributes:array<struct<name:string,value:string>>,value:string,target:string,"
    "data:string,version:string,encoding:string,standalone:string,publicId:string,systemId:string,declaration:string>>"
)


def detect_encoding(content: Column) -> Column:
    """Encoding by byte order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), "UTF-8")
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
        .otherwise("UTF-8")
    )


def decode_content(content: Column) -> Column:
    """Text of a file's bytes, without the byte order mark."""
    encoding = detect_encoding(content)
    text = F.when(encoding == "UTF-16LE", F.decode(content, "UTF-16LE")).when(encoding == "UTF-16BE", F.decode(content, "UTF-16BE")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^﻿", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, doc_id, xml`` of whole files; the id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.xxhash64("path").alias("doc_id"), decode_content(F.col("content")).alias("xml"))


def read_records(spark: SparkSession, path: str, row_tag: str, schema: str, xsd: str | None = None) -> DataFrame:
    """Typed records by row tag, with the built-in reader; ``xsd`` validates each row."""
    reader = spark.read.format("xml").option("rowTag", row_tag).schema(schema)
    return (reader.option("rowValidationXSDPath", xsd) if xsd else reader).load(path)


def read_events(json: Column) -> Column:
    """An array of event structs from its JSON text; null where the text isn't one."""
    return F.from_json(json, EVENT_SCHEMA)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")
