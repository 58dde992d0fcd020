"""The suite runner on a small manifest."""

from treeloom.operators.suite import report, run_suite, schema_faults
from treeloom.queries.typed import XS

SCHEMA = f'{XS}><xs:include schemaLocation="more.xsd"/><xs:element name="v" type="few"/></xs:schema>'
MORE = f'{XS}><xs:simpleType name="few"><xs:restriction base="xs:int"><xs:maxInclusive value="9"/></xs:restriction></xs:simpleType></xs:schema>'
TEST = '<{0}Test name="{1}"><{0}Document xlink:href="{1}"/><expected validity="{2}"/>{3}</{0}Test>'
MANIFEST = (
    '<testSet xmlns:xlink="l" contributor="me"><testGroup name="g">'
    + TEST.format("schema", "a.xsd", "valid", "")
    + "".join(TEST.format("instance", *t) for t in (("1.xml", "valid", ""), ("2.xml", "invalid", ""), ("3.xml", "valid", ""), ("4.xml", "invalid", ""), ("5.xml", "valid", ""), ("1.xml", "invalid", '<current status="disputed"/>')))
    + '</testGroup><testGroup name="h">' + TEST.format("schema", "bad.xsd", "invalid", "") + TEST.format("instance", "/s/1.xml", "valid", "") + '</testGroup><testGroup name="i">' + TEST.format("instance", "1.xml", "valid", "") + "</testGroup></testSet>"
)
FILES = {"a.xsd": SCHEMA, "more.xsd": MORE, "bad.xsd": f'{XS}><xs:element/></xs:schema>', "1.xml": "<v>5</v>", "2.xml": "<v>12</v>", "3.xml": "<v>12</v>", "4.xml": "<v>", "noise.txt": "x"}


def test_outcomes_and_totals(spark):
    manifests = spark.createDataFrame([(0, "/s/set.xml", MANIFEST)], "doc_id long, path string, xml string")
    files = spark.createDataFrame([(f"/s/{k}", v) for k, v in FILES.items()], "path string, xml string")
    outcomes = run_suite(manifests, files)
    got = sorted((r.test_group, r.kind, r.test, r.expected, r.actual or "", r.outcome) for r in outcomes.collect())
    assert got == sorted([
        ("g", "schema", "a.xsd", "valid", "valid", "passed"), ("g", "instance", "1.xml", "valid", "valid", "passed"), ("g", "instance", "2.xml", "invalid", "invalid", "passed"),
        ("g", "instance", "3.xml", "valid", "invalid", "failed"), ("g", "instance", "4.xml", "invalid", "invalid", "passed"), ("g", "instance", "5.xml", "valid", "", "skipped"),
        ("g", "instance", "1.xml", "invalid", "valid", "skipped"), ("h", "schema", "bad.xsd", "invalid", "invalid", "passed"), ("h", "instance", "/s/1.xml", "valid", "", "skipped"), ("i", "instance", "1.xml", "valid", "", "skipped"),
    ])
    totals = {(r.contributor, r.kind): (r.total, r.passed, r.failed, r.skipped) for r in report(outcomes).collect()}
    assert totals[None, None] == (10, 5, 1, 4) and totals["me", "schema"] == (2, 2, 0, 0)


def test_documents_that_are_no_schemas(spark):
    rows = spark.createDataFrame([(1, "<x/>"), (2, "<x"), (3, None), (4, "")], "k long, xml string").select("k", schema_faults("xml").alias("f")).collect()
    found = {r.k: r.f for r in rows}
    assert found[3] is None and [f.rule for f in found[2]] == ["not-a-schema"] == [f.rule for f in found[4]]
