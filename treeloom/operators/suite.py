"""Conformance suites: manifests name schemas and instances with the validity expected of them; each is judged, and told as passed, failed or skipped.

A manifest is a document ``testSet(@contributor) > testGroup(@name) > schemaTest |
instanceTest (@name)``; a test names its documents (``schemaDocument`` or
``instanceDocument`` with an ``href``, relative to the manifest), the ``expected``
validity and, where it has one, its ``current`` status.  Prefixes don't matter.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_of
from ..plans.assess import SchemaGrammar
from ..plans.lineage import stored
from ..plans.xsd import Schema
from ..plans.xsd_rules import check_schema
from ..sources.tokenizer import nodes_of, parse
from .validate import xsd_violations

FAULTS = "array<struct<rule:string,message:string>>"


def schema_faults(text: Column) -> Column:
    """Rules that a schema document breaks; ``not-a-schema`` where it can't be read as one. Null stays null."""

    def judge(xml: str) -> list[dict]:
        try:
            return [{"rule": r, "message": m} for r, m in check_schema(xml)]
        except (ValueError, KeyError, IndexError, AttributeError, TypeError, StopIteration) as e:
            return [{"rule": "not-a-schema", "message": str(e)}]

    @F.pandas_udf(FAULTS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(judge, na_action="ignore").astype(object)

    return run(text)


def named(attrs: Column, name: str) -> Column:
    """Value of an attribute by its local name."""
    return F.get(F.filter(attrs, lambda a: local_of(a["name"]) == name), F.lit(0))["value"]


def manifest_tests(manifests: DataFrame) -> DataFrame:
    """``contributor, test_group, kind, test, paths, expected, status`` of manifests (``doc_id, path, xml``), one row for each test."""
    nodes = nodes_of(parse(manifests.select("doc_id", "xml")))
    el = stored(nodes.where("kind = 'element'").select("doc_id", "pre", "parent", local_of(F.col("name")).alias("local"), "attrs"))
    sets = el.where("parent = -1").select("doc_id", F.coalesce(named(F.col("attrs"), "contributor"), F.lit("")).alias("contributor"))
    groups = el.where("local = 'testGroup'").select("doc_id", F.col("pre").alias("parent"), named(F.col("attrs"), "name").alias("test_group"))
    tests = el.where("local in ('schemaTest', 'instanceTest')").join(groups, ["doc_id", "parent"]).select(
        "doc_id", "test_group", F.col("pre").alias("parent"), F.regexp_replace("local", "Test$", "").alias("kind"), named(F.col("attrs"), "name").alias("test")
    )
    about = el.where("local in ('schemaDocument', 'instanceDocument', 'expected', 'current')").groupBy("doc_id", "parent").agg(
        F.sort_array(F.collect_list(F.when(F.col("local").endswith("Document"), F.struct("pre", named(F.col("attrs"), "href").alias("href"))))).alias("hrefs"),
        F.max(F.when(F.col("local") == "expected", named(F.col("attrs"), "validity"))).alias("expected"),
        F.max(F.when(F.col("local") == "current", named(F.col("attrs"), "status"))).alias("status"),
    )
    folder = F.regexp_replace("path", "[^/]*$", "")
    paths = F.transform("hrefs", lambda h: F.when(h["href"].startswith("/"), h["href"]).otherwise(F.concat("folder", h["href"])))
    return (
        tests.join(about, ["doc_id", "parent"], "left")
        .join(sets, "doc_id")
        .join(manifests.select("doc_id", folder.alias("folder")), "doc_id")
        .select("contributor", "test_group", "kind", "test", F.coalesce(paths, F.array().cast("array<string>")).alias("paths"), "expected", "status")
    )


def run_suite(manifests: DataFrame, files: DataFrame, most: int = 10_000) -> DataFrame:
    """``contributor, test_group, kind, test, expected, actual, outcome`` for every test of the manifests.

    ``files`` (``path, xml``) holds the documents.  Outcomes are ``passed``, ``failed`` and
    ``skipped``: tests of another status than ``accepted`` (none counts as accepted), those
    whose documents are missing, and instances whose group has no schema that holds.
    Schema documents are judged as rows.  The schemas of groups with instances, ``most`` at
    most, are compiled on the driver; all instances are then judged in one pass.
    """
    spark = manifests.sparkSession
    tests = stored(manifest_tests(manifests).withColumn("test_id", F.monotonically_increasing_id()))
    wanted = tests.select("test_id", "kind", F.posexplode("paths").alias("at", "path")).join(files, "path", "left")
    of_schema = wanted.where("kind = 'schema'").select("test_id", "path", F.col("xml").isNull().alias("lost"), F.coalesce(F.size(schema_faults(F.col("xml"))), F.lit(0)).alias("faults"))
    schemas = of_schema.groupBy("test_id").agg(F.max("lost").alias("lost"), (F.sum("faults") > 0).alias("broken"))

    # the schema of a group: all documents of its schema tests
    group = ["contributor", "test_group"]
    own = tests.where("kind = 'schema'").groupBy(*group).agg(F.flatten(F.collect_list("paths")).alias("places"))
    instances = tests.where("kind = 'instance'").join(own, group, "left")
    distinct = [tuple(r["places"]) for r in instances.where("places is not null").select("places").distinct().limit(most + 1).collect()]
    if len(distinct) > most:
        raise ValueError(f"more than {most} schemas")
    needed = spark.createDataFrame([(p,) for p in sorted({p for places in distinct for p in places})], "path string")
    texts = {r["path"]: r["xml"] for r in files.join(F.broadcast(needed), "path", "left_semi").collect()}

    def read(path: str) -> str:
        if path not in texts:  # included ones
            found = files.where(F.col("path") == posixpath.normpath(path)).head(1)
            if not found:
                raise KeyError(path)
            texts[path] = found[0]["xml"]
        return texts[path]

    compiled, numbers = [], []
    for places in sorted(distinct):
        try:
            schema = None if any(check_schema(read(p)) for p in places) else Schema(list(places), read)
        except (KeyError, ValueError):
            schema = None
        if schema is None:  # a schema that doesn't hold judges nothing
            continue
        numbers.append((list(places), len(compiled)))
        compiled.append(schema)
    numbered = instances.join(F.broadcast(spark.createDataFrame(numbers, "places array<string>, number int")), "places", "left").select("test_id", "number")
    docs = stored(wanted.where("kind = 'instance'").join(numbered, "test_id").select(F.monotonically_increasing_id().alias("doc_id"), "test_id", "number", "xml"))
    judged = docs.where("xml is not null and number is not null")
    parsed = stored(parse(judged.select("doc_id", "xml")))
    bad = parsed.where("kind = 'error'").select("doc_id")
    if compiled:
        bad = bad.union(xsd_violations(nodes_of(parsed).join(judged.select("doc_id", "number"), "doc_id"), SchemaGrammar(compiled), "number").select("doc_id"))
    found = (
        docs.join(bad.distinct().withColumn("bad", F.lit(True)), "doc_id", "left")
        .groupBy("test_id")
        .agg(F.max(F.col("xml").isNull() | F.col("number").isNull()).alias("lost"), F.max(F.coalesce("bad", F.lit(False))).alias("broken"))
    )
    out = tests.join(schemas.union(found), "test_id", "left")
    settled = (F.coalesce("status", F.lit("accepted")) == "accepted") & F.col("expected").isin("valid", "invalid")
    actual = F.when(F.coalesce("lost", F.lit(True)), F.lit(None)).when(F.col("broken"), "invalid").otherwise("valid")
    out = out.withColumn("actual", actual)
    outcome = F.when(~F.coalesce(settled, F.lit(False)) | F.col("actual").isNull(), "skipped").when(F.col("actual") == F.col("expected"), "passed").otherwise("failed")
    return out.select(*group, "kind", "test", "expected", "actual", outcome.alias("outcome"))


def report(outcomes: DataFrame) -> DataFrame:
    """Totals for each contributor and kind, for each contributor, and in all (nulls): ``total, passed, failed, skipped``."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.rollup("contributor", "kind").agg(F.count("*").alias("total"), count("passed"), count("failed"), count("skipped"))
