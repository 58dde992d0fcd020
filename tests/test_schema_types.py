"""Schema types by state, IDs by type, identity by rule, on small documents; parsed with the grammar and assessed afterwards alike."""

import pytest

from treeloom.operators import validate as val
from treeloom.plans.assess import DtdGrammar, Entered, SchemaGrammar
from treeloom.plans.dtd import compile_dtd
from treeloom.plans.xsd import compile_schema
from treeloom.queries.typed import IDS_XSD, INSTANCE, NARROWED_XSD, NESTED_XSD, QNAME_XSD, TWO_SPACES, XS
from treeloom.sources.tokenizer import assess, nodes_of, parse


def broken(spark, schema, texts):
    """Rules that each document breaks, by either way of reading them."""
    sources = {"s": schema} if isinstance(schema, str) else schema
    compiled = compile_schema(next(iter(sources)), sources)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    grammar = SchemaGrammar([compiled])
    at_once = val.xsd_violations(nodes_of(parse(docs, grammar=grammar)), grammar)
    later = val.xsd_violations(nodes_of(parse(docs)).repartition(3, "pre"), compiled)
    one, other = (sorted((r.doc_id, r.pre, r.rule, r.message) for r in df.collect()) for df in (at_once, later))
    assert one == other
    return [sorted(r for d, _, r, _ in one if d == n) for n in range(len(texts))]


SPACES = '<t:d xmlns:t="urn:t" xmlns:o="urn:o"><t:p><t:v>{}</t:v></t:p><o:p><v>{}</v></o:p></t:d>'
LOCAL = f"""{XS}><xs:element name="d"><xs:complexType><xs:sequence>
<xs:element name="a"><xs:complexType><xs:sequence><xs:element name="p" maxOccurs="9"><xs:complexType><xs:attribute name="k"/></xs:complexType></xs:element></xs:sequence></xs:complexType><xs:unique name="u"><xs:selector xpath="p"/><xs:field xpath="@k"/></xs:unique></xs:element>
<xs:element name="b"><xs:complexType><xs:sequence><xs:element name="a"><xs:complexType><xs:sequence><xs:element name="p" maxOccurs="9"><xs:complexType><xs:attribute name="k"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""
TYPED = f'<d xmlns:i="{INSTANCE}"><e{{}}><p><v>{{}}</v></p></e><n{{}}>{{}}</n></d>'


CASES = [
    (TWO_SPACES, SPACES.format("1", "w"), []),
    (TWO_SPACES, SPACES.format("w", "1"), ["value-type", "value-type"]),
    (TWO_SPACES, SPACES.format("1", "w").replace("<v>w</v>", "<t:v>1</t:v>"), ["content-model", "element-undeclared"]),
    (NARROWED_XSD, TYPED.format("", "abc", "", "5"), []),
    (NARROWED_XSD, TYPED.format(' i:type="res"', "abc", "", "5"), ["value-type"]),
    (NARROWED_XSD, TYPED.format(' i:type="res"', "12", ' i:type="few"', "9"), []),
    (NARROWED_XSD, TYPED.format(' i:type="none"', "abc", ' i:type="few"', "10"), ["type-unknown", "value-type"]),
    (NARROWED_XSD, TYPED.format(' i:type="few"', "abc", ' i:type="res"', "5"), ["type-blocked", "type-blocked", "content-simple", "content-model", "content-text", "element-undeclared", "element-undeclared", "value-type"]),
    (NARROWED_XSD, TYPED.format("", "abc", f' xmlns:x="{XS[-33:-1]}" i:type="x:int"', "5"), []),
    (LOCAL, '<d><a><p k="1"/><p k="2"/></a><b><a><p k="1"/><p k="1"/></a></b></d>', []),
    (LOCAL, '<d><a><p k="1"/><p k="1"/></a><b><a><p k="1"/></a></b></d>', ["unique"]),
    (NESTED_XSD, '<w><g><c k="1"/><c k="2"/></g><g><c k="3"/></g><old><g><c k="1"/><c k="1"/></g></old><r k="1"/><r k="3"/></w>', []),
    (NESTED_XSD, '<w><g><c k="1"/></g><g><c k="1"/></g><old><g/></old><r k="1"/></w>', ["keyref"]),
    (NESTED_XSD, '<w><g><c k="1"/></g><old><g><c k="2"/></g></old><r k="2"/></w>', ["keyref"]),
    (NESTED_XSD, '<w><g><c/></g><old><g><c/></g></old></w>', ["key-field"]),
    (IDS_XSD, '<g><x id="a" u="3"><k>p1</k><r>p1  p2</r></x><x id="a" u="p1"><k>p2</k><r>p1</r></x></g>', []),
    (IDS_XSD, '<g><x u="p9"><k>p1</k><r>p1 p3</r></x><x><k>p1</k><r>p1</r></x></g>', ["id-repeated", "id-repeated", "idref-dangling", "idref-dangling"]),
    (QNAME_XSD, '<q:d xmlns:q="urn:q"><q:e a="q:x">y</q:e></q:d>', []),
    (QNAME_XSD, '<q:d xmlns:q="urn:q"><q:e a="z:x">z:y</q:e></q:d>', ["attribute-type", "value-type"]),
]
SCHEMAS = {"spaces": TWO_SPACES, "narrowed": NARROWED_XSD, "local": LOCAL, "nested": NESTED_XSD, "ids": IDS_XSD, "qname": QNAME_XSD}


@pytest.mark.parametrize("name", SCHEMAS)
def test_rules_broken(spark, name):
    own = [(xml, sorted(rules)) for schema, xml, rules in CASES if schema is SCHEMAS[name]]
    assert len(own) > 1 and broken(spark, SCHEMAS[name], [xml for xml, _ in own]) == [rules for _, rules in own]


def test_rows_assessed_afterwards_equal_those_assessed_while_parsing(spark):
    xml = "<d>x<![CDATA[y]]><!-- c --><e i:type='res' xmlns:i='" + INSTANCE + "'><p><v a='1' i:nil='true'>1<w/>2</v></p></e><n>3</n></d>"
    docs = spark.createDataFrame([(1, xml), (2, "<d>"), (3, "<n/>")], "doc_id long, xml string")
    grammar = SchemaGrammar([compile_schema("s", {"s": NARROWED_XSD})])
    one = parse(docs, grammar=grammar).where("kind = 'element'")
    later = assess(nodes_of(parse(docs)), grammar)
    columns = later.columns
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, later.collect()))
    assert parse(docs, grammar=grammar).where("kind = 'error'").count() == 1


def test_dtd_sequences_while_parsing(spark):
    docs = spark.createDataFrame([(1, "<a><b/>x<c/></a>"), (2, "<a><c/><b/></a>")], "doc_id long, xml string")
    dtd = compile_dtd("<!ELEMENT a (b, c)><!ELEMENT b EMPTY><!ELEMENT c EMPTY>")
    plain, given = (val.dtd_violations(nodes_of(parse(docs, grammar=g)), dtd) for g in (None, DtdGrammar()))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, given.collect())) and given.count() == 2


def test_a_grammar_of_ones_own(spark):
    class Pairs:
        """Which child may stand in which parent."""

        def __init__(self, allowed):
            self.allowed = allowed

        def start(self, number):
            return None

        def enter(self, state, ns, name, attrs, bound):
            return Entered(name, declared=0 if state is None or name in self.allowed.get(state, ()) else None)

        def token(self, ns, name):
            return f"{name} "

    docs = spark.createDataFrame([(1, "<a><b/><c/><b><c/></b></a>")], "doc_id long, xml string")
    rows = parse(docs, grammar=Pairs({"a": ["b"], "b": ["c"]})).where("kind = 'element' and declared is null").select("path").collect()
    assert [r.path for r in rows] == ["/a/c"]


def test_many_schemas_in_one_pass(spark):
    number = f'{XS}><xs:element name="r" type="xs:{{}}"/></xs:schema>'
    texts = {f"/x/{k}.xsd": number.format(k) for k in ("int", "NCName")}
    doc = f'<r xmlns:i="{INSTANCE}" i:noNamespaceSchemaLocation="{{}}">{{}}</r>'
    rows = [(1, doc.format("/x/int.xsd", "5")), (2, doc.format("int.xsd", "w")), (3, doc.format("NCName.xsd", "w")), (4, doc.format("/x/NCName.xsd", "5")), (5, doc.format("gone.xsd", "5")), (6, "<r/>")]
    nodes = nodes_of(parse(spark.createDataFrame(rows, "doc_id long, xml string")))
    bases = spark.createDataFrame([(k, "/x/doc.xml") for k, _ in rows], "doc_id long, base string")
    found = val.violations_by_location(nodes, texts.__getitem__, bases=bases)
    assert sorted((r.doc_id, r.rule) for r in found.collect()) == [(2, "value-type"), (4, "value-type"), (5, "schema-missing")]
    answers = lambda asked: asked.where("location = 'gone.xsd'").selectExpr("ns", "location", "'/x/NCName.xsd' as place")
    named = val.violations_by_location(nodes.where("doc_id in (1, 5)"), texts.__getitem__, locate=answers)
    assert [(r.doc_id, r.rule) for r in named.collect()] == [(5, "value-type")]
    with pytest.raises(ValueError):
        val.violations_by_location(nodes, texts.__getitem__, most=1, bases=bases)
