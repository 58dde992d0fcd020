"""Queries that judge schemas and instances as rows of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.suite import report, run_suite, schema_faults
from ..plans.xsd_rules import BAD_EXAMPLES, GOOD_EXAMPLES
from .synth import table
from .typed import XS, text


def xsd_rules_over_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema document for each part: by its number one that breaks a rule, or its neighbour that breaks none; every rule both ways."""
    rules = sorted(BAD_EXAMPLES)
    examples = F.array(*[F.lit(t) for r in rules for t in (BAD_EXAMPLES[r], GOOD_EXAMPLES[r])])
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(examples, (F.col("p_partkey") % (2 * len(rules))).cast("int")).alias("xml"))
    found = p.select("p_partkey", F.array_distinct(F.transform(schema_faults(F.col("xml")), lambda f: f["rule"])).alias("rules"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "breaks").otherwise("holds")
    return found.groupBy(kind.alias("kind"), F.array_join(F.array_sort("rules"), ",").alias("rules")).agg(F.count("*").alias("n"))


#: Customers whose numbers share a block are told by one manifest of their region.
BLOCK = 10_000


def suite_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of each region, a group for each nation, an instance for each customer; some expectations are wrong, some tests disputed, some documents lost.

    A region has a manifest for each block of customers, so that none grows with the table;
    a nation's schema is tested in the first that has the nation.
    """
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    valid = lambda ok: F.when(ok, "valid").otherwise("invalid")
    # every sixth nation's schema is no schema; every fifth customer's document is not well formed
    schema = text(f'{XS}><xs:element name="v"><xs:simpleType><xs:restriction base="xs:int"><xs:maxInclusive value="', nation, '"/></xs:restriction></xs:simpleType></xs:element>', F.when(nation % 6 == 5, '<xs:element name="v"/>').otherwise(""), "</xs:schema>")
    schemas = n.select(text("/s/", F.col("n_regionkey"), "/n", nation, ".xsd").alias("path"), schema.alias("xml"))
    joined = c.join(n, F.col("c_nationkey") == nation)
    good = (key % 25 <= nation) & (key % 5 != 4)
    instances = joined.where(key % 11 != 10).select(text("/s/", F.col("n_regionkey"), "/i/c", key, ".xml").alias("path"), text("<v>", (key % 25).cast("string"), F.when(key % 5 == 4, "").otherwise("</v>")).alias("xml"))
    expected = valid(good != (key % 7 == 3))  # wrong for some
    test = text('<t:instanceTest name="i', key, '"><t:instanceDocument x:href="i/c', key, '.xml"/><t:expected validity="', expected, '"/>', F.when(key % 13 == 0, '<t:current status="disputed"/>').when(key % 13 == 1, '<t:current status="accepted"/>').otherwise(""), "</t:instanceTest>")
    block = F.floor(key / BLOCK).cast("long")
    first = F.broadcast(c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min(block).alias("first")))
    tests = joined.groupBy("n_nationkey", "n_regionkey", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), test.alias("x")))), lambda r: r["x"]), "").alias("tests")).join(first, "n_nationkey")
    of_schema = text('<t:schemaTest name="s"><t:schemaDocument x:href="n', nation, '.xsd"/><t:expected validity="', valid(nation % 4 != 3), '"/></t:schemaTest>')
    group = text('<t:testGroup name="n', nation, '">', F.when(F.col("block") == F.col("first"), of_schema).otherwise(""), F.col("tests"), "</t:testGroup>")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", group.alias("x")))), lambda r: r["x"]), "")
    region = F.col("n_regionkey")
    manifests = tests.groupBy(region, "block").agg(body.alias("body")).select(
        (F.col("block") * 1000 + region).alias("doc_id"), text("/s/", region, "/set", F.col("block"), ".xml").alias("path"), text('<t:testSet xmlns:t="urn:suite" xmlns:x="urn:link" contributor="r', region, '">', F.col("body"), "</t:testSet>").alias("xml")
    )
    return report(run_suite(manifests, schemas.union(instances)))


QUERIES = {f.__name__: f for f in (xsd_rules_over_parts, suite_by_region)}

_RULES = sorted(BAD_EXAMPLES)
_SUITE = """(select 'r' || n_regionkey as contributor, 'schema' as kind, (n_nationkey % 6 != 5) as good, n_nationkey % 4 != 3 as expected, false as skipped from nation where n_nationkey in (select c_nationkey from customer)
union all select 'r' || n_regionkey, 'instance', c_custkey % 25 <= n_nationkey and c_custkey % 5 != 4, (c_custkey % 25 <= n_nationkey and c_custkey % 5 != 4) != (c_custkey % 7 = 3), c_custkey % 13 = 0 or c_custkey % 11 = 10 or n_nationkey % 6 = 5 from customer join nation on c_nationkey = n_nationkey)"""
ORACLES = {
    "xsd_rules_over_parts": f"select kind, rules, count(*) as n from (select case when p_partkey % 2 = 0 then 'breaks' else 'holds' end as kind, case when p_partkey % 2 = 0 then [{', '.join(repr(r) for r in _RULES)}][cast(p_partkey % {2 * len(_RULES)} // 2 as int) + 1] else '' end as rules from part) group by 1, 2",
    "suite_by_region": f"select contributor, kind, count(*) as total, count(*) filter (not skipped and good = expected) as passed, count(*) filter (not skipped and good != expected) as failed, count(*) filter (skipped) as skipped from {_SUITE} group by rollup (contributor, kind)",
}
