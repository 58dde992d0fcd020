"""Parts of the engine on small inputs: the parser's edges, JSON samples, grammars, patterns."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.functions import datatypes as dt
from treeloom.functions.patterns import PatternError, translate
from treeloom.operators import json as js
from treeloom.operators import navigate as nav
from treeloom.operators import serialize as ser
from treeloom.plans.catalog import Catalog
from treeloom.plans.dtd import compile_dtd
from treeloom.plans.xsd import compile_schema
from treeloom.plans.xsd_rules import BAD_EXAMPLES, GOOD_EXAMPLES, check_schema, check_together
from treeloom.sources.readers import decode_content, read_documents
from treeloom.sources.tokenizer import DocumentParser, NodeRows, nodes_of, parse, pseudo_attributes, status_of


def columns(xml):
    rows = NodeRows()
    DocumentParser(rows).parse(1, xml)
    return rows.columns


def test_regions_enclose_their_subtrees():
    c = columns("<a><b><c/></b>t<b/></a>")
    assert list(zip(c["name"], c["pre"], c["post"], c["level"], c["occ"])) == [("a", 0, 4, 0, 0), ("b", 1, 2, 1, 0), ("c", 2, 2, 2, 0), (None, 3, 3, 1, 0), ("b", 4, 4, 1, 1)]


@pytest.mark.parametrize("xml", [None, "", "   ", "<a>", "<a></b>", "<a/><b/>", "<a x='1' x='2'/>", "<a>&u;</a>", "<a>]]></a>", "text", "<a>\x01</a>", '<?xml version="1.0" encoding="ISO-8859-1"?><a/>'])
def test_bad_documents_give_one_error_row(xml):
    assert columns(xml)["kind"] == ["error"]


@pytest.mark.parametrize("cut", range(1, 60, 7))
def test_chunks_of_any_cut_give_the_same_nodes(cut):
    xml = '<?xml version="1.0"?><!DOCTYPE a [<!ENTITY e "v">]><a k="é"><![CDATA[x]]>&e;<!-- c --><?p d?></a>'
    whole, pieces = NodeRows(), NodeRows()
    DocumentParser(whole).parse(1, xml)
    DocumentParser(pieces).parse(1, [xml[i : i + cut] for i in range(0, len(xml), cut)])
    assert whole.columns == pieces.columns


@pytest.mark.parametrize("unit", ["x", "é", "a&amp;", "a\n"])
def test_a_text_longer_than_the_parsers_buffer_is_one_node(unit):
    text = (unit * 200_000).replace("&amp;", "&")
    c = columns(f"<a>{unit * 200_000}<b/>{unit * 200_000}<!-- c -->t<![CDATA[{text}]]>t</a>")
    assert c["kind"] == ["element", "text", "element", "text", "comment", "text", "cdata", "text"]
    assert [c["value"][k] for k in (1, 3, 6)] == [text] * 3 and c["sib"][1:] == list(range(7))


def test_serialised_samples_come_back(spark):
    samples = [
        '<?xml version="1.1" standalone="yes"?><!-- a --><?p q?><r xmlns:n="urn:n"><n:c x="&quot;&lt;"><![CDATA[<&>]]>t&amp;</n:c><e/></r><!-- z -->',
        '<!DOCTYPE l SYSTEM "l.dtd"><l>\n <b/> \n</l>',
        '<!DOCTYPE l PUBLIC "p" "s" [<!ELEMENT l ANY><!-- ] -->]><l/>',
    ]
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, xml string")
    got = {r.doc_id: r.xml for r in ser.to_text(nodes_of(parse(docs))).collect()}
    assert got == dict(enumerate(samples))
    again = {r.doc_id: r.xml for r in ser.events_to_text(ser.events(nodes_of(parse(docs)))).collect()}
    assert again == got


def test_lossless_json_comes_back():
    xml = '<?xml version="1.0" encoding="utf-8"?><!-- p --><!DOCTYPE r [<!ENTITY w "x">]><?a b?><r k="1">t<c>1</c><![CDATA[d]]><c>2</c><!-- m --><d/>u</r><!-- e -->'
    value = js.document_value(js.build_tree(xml), lossless=True)
    assert js.is_lossless(value) and value["root"]["_content"][0] == {"kind": "text", "value": "t"}
    assert js.document_text(json.loads(json.dumps(value))) == xml


def test_light_json_rules():
    light = lambda x: js.document_value(js.build_tree(x), lossless=False)
    assert light("<a/>") == "" and light("<a> </a>") == " "
    assert light("<books><book>1</book></books>") == ["1"]
    assert light("<a><b>1</b><b/></a>") == {"b": ["1", ""]}
    assert light('<a k="v"> <b/> </a>') == {"_attributes": {"k": "v"}, "b": ""}
    plain = {"library": "City", "books": ["A", "B"], "prices": [1, 2.5]}
    assert js.document_text(plain, "shelf") == "<shelf><library>City</library><books>A</books><books>B</books><prices>1</prices><prices>2.5</prices></shelf>"
    assert js.infer_root({"library": {}, "_text": "x"}) == "library" and js.infer_root({"a": 1, "b": 2}) is None


NAMES = st.sampled_from(["a", "b", "c", "entries"])  # a lone child named by its parent's singular is a bare array, which loses its parent
TREES = st.recursive(st.text("x<&\"' é", max_size=4), lambda kids: st.lists(st.tuples(NAMES, kids), max_size=4), max_leaves=12)


def to_xml(name, tree):
    from xml.sax.saxutils import escape

    inner = escape(tree) if isinstance(tree, str) else "".join(to_xml(n, t) for n, t in tree)
    return f"<{name}>{inner}</{name}>" if inner else f"<{name}/>"


@settings(max_examples=150, deadline=None)
@given(TREES)
def test_any_tree_survives_lossless_json(tree):
    xml = to_xml("r", tree)
    assert js.document_text(js.document_value(js.build_tree(xml), lossless=True)) == xml


def test_file_encodings(spark, tmp_path):
    text = "<a>é</a>"
    for name, data in {"u8": text.encode(), "u8b": b"\xef\xbb\xbf" + text.encode(), "le": b"\xff\xfe" + text.encode("utf-16-le"), "be": b"\xfe\xff" + text.encode("utf-16-be")}.items():
        (tmp_path / f"{name}.xml").write_bytes(data)
    docs = read_documents(spark, str(tmp_path))
    assert {r.xml for r in docs.collect()} == {text}
    assert status_of(parse(docs)).where("well_formed").count() == 4
    assert decode_content(F.lit(b"x")) is not None


def test_dtd_conditional_sections_and_errors():
    g = compile_dtd('<!ENTITY % x SYSTEM "more"> %x; <!ELEMENT a (b|c)*>', {"more": "<![IGNORE[<!ELEMENT z ANY>]]><!NOTATION n SYSTEM 'v'>"})
    assert list(g.models) == ["a"] and g.models["a"][3] == "(b|c)*" and g.notations == {"n": (None, "v")}
    with pytest.raises(ValueError):
        compile_dtd("<!ELEMENT a (b>")


@pytest.mark.parametrize("rule", sorted(BAD_EXAMPLES))
def test_each_bad_schema_breaks_its_rule(rule):
    assert {r for r, _ in check_schema(BAD_EXAMPLES[rule])} == {rule}
    assert check_schema(GOOD_EXAMPLES[rule]) == []


def test_included_namespace():
    xs = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="{}"/>'
    assert [r for r, _ in check_together([xs.format("urn:a"), xs.format("urn:b")])] == ["SEM-15"]
    assert check_together([xs.format("urn:a"), xs.format("urn:a")]) == []


@pytest.mark.parametrize("bad", ["(", ")", "[]", "[a", "a{2,1}", r"\q", "*a", r"\p{Xx}", "[a[b]]"])
def test_bad_patterns_are_refused(bad):
    with pytest.raises(PatternError):
        translate(bad)


def test_catalog_cycle():
    files = {"/a": '<catalog><nextCatalog catalog="/b"/></catalog>', "/b": '<catalog><nextCatalog catalog="/a"/></catalog>'}
    with pytest.raises(ValueError):
        Catalog("/a", files.__getitem__)


def test_unknown_types_allow_everything(spark):
    row = spark.range(1).select(dt.is_valid(F.lit("x"), "unknown").alias("u"), dt.is_valid(F.lit("x"), "error").alias("e")).first()
    assert (row.u, row.e) == (True, False)


def test_pseudo_attributes():
    assert pseudo_attributes("href=\"a.rng\" type='x'") == {"href": "a.rng", "type": "x"}


def test_edited_trees_have_the_regions_of_a_fresh_parse(spark):
    from treeloom.operators import edit

    docs = spark.createDataFrame([(1, "<a><b><c/>t</b><b/><d><b><c/></b></d></a>"), (2, "<b/>")], "doc_id long, xml string")
    nodes = nodes_of(parse(docs))
    more = edit.append_child(nodes, F.col("name") == "b", "element", F.lit("n"), None)
    less = edit.remove_subtrees(more, more.where("name = 'c'"))
    xml = {r.doc_id: r.xml for r in ser.to_text(less).collect()}
    assert xml == {1: "<a><b>t<n/></b><b><n/></b><d><b><n/></b></d></a>", 2: "<b><n/></b>"}
    fresh = nodes_of(parse(spark.createDataFrame(list(xml.items()), "doc_id long, xml string")))
    columns = ["doc_id", "pre", "post", "level", "parent", "sib", "occ", "kind", "name", "path"]
    assert sorted(map(repr, less.select(columns).collect())) == sorted(map(repr, fresh.select(columns).collect()))


def test_written_documents_come_back_character_for_character(spark, tmp_path):
    texts = ["<?xml version='1.0'?>\n<a\n b='1'>\n<!--\n--><![CDATA[\n]]></a>\n", "<b/>", "<c>\r\n\té</c>\n\n"]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, xml string")
    for each in (True, False):
        js.write_xml(docs, str(tmp_path / str(each)), one_file_each=each)
        back = js.read_xml(spark, str(tmp_path / str(each)), one_file_each=each).collect()
        assert sorted(r.xml for r in back) == sorted(texts)
    assert {r.doc_id: r.xml for r in js.read_xml(spark, str(tmp_path / "True"), one_file_each=True).collect()} == dict(enumerate(texts))


def test_types_that_instances_may_name():
    derived = '<xs:complexType name="{0}"><xs:complexContent><xs:{1} base="{2}"/></xs:complexContent></xs:complexType>'
    text = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" blockDefault="restriction"><xs:complexType name="b"/>{}<xs:element name="e" type="b"/><xs:element name="f" type="b" block=""/><xs:element name="a"/></xs:schema>'
    schema = compile_schema("s", {"s": text.format("".join(derived.format(*d) for d in (("x", "extension", "b"), ("r", "restriction", "x"))) + '<xs:complexType name="o"/>')})
    allowed = lambda e: [n for n in "bxro" if schema.globals["", e].allows(schema.type(("", n)))]
    assert allowed("e") == ["b", "x"]
    assert allowed("f") == ["b", "x"]  # the type's own default still blocks
    assert allowed("a") == list("bxro")


def test_attribute_wildcards_combine():
    group = '<xs:attributeGroup name="{0}"><xs:anyAttribute namespace="{1}" processContents="{2}"/></xs:attributeGroup>'
    text = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="t" xmlns="t">{}<xs:complexType name="c"><xs:attributeGroup ref="g"/><xs:attributeGroup ref="h"/></xs:complexType><xs:complexType name="d"><xs:complexContent><xs:extension base="c"><xs:anyAttribute namespace="u" processContents="skip"/></xs:extension></xs:complexContent></xs:complexType></xs:schema>'
    schema = compile_schema("s", {"s": text.format(group.format("g", "##other", "lax") + group.format("h", "v t", "strict"))})
    assert schema.type(("t", "c")).any_attribute == (("in", frozenset(["v"])), "strict")
    assert schema.type(("t", "d")).any_attribute == (("in", frozenset(["u", "v"])), "skip")


def test_plain_steps_and_intervals_select_alike(spark):
    nodes = nodes_of(parse(spark.createDataFrame([(1, "<r><a><b/><p:b xmlns:p='u'/></a><b/><a><c><b/></c></a></r>")], "doc_id long, xml string")))
    found = lambda s: sorted((r["anc_pre"], r["pre"]) for r in nav.select(nav.roots(nodes), nodes, s).collect())
    for plain in ("a/b", "./a/*", "child::a/child::c/b", ".", "p:b"):
        assert found(plain) == found(f"{plain}|zz")  # alternatives meet by interval



def test_scopes_inside_each_other_meet_their_nodes(spark):
    xml = "<a><b><c>1</c><b><c>2</c><d><c>3</c></d></b></b><c>4</c><b><c/>5</b></a>"
    nodes = nodes_of(parse(spark.createDataFrame([(1, xml), (2, "<a><b><b><b><c/></b></b></b></a>")], "doc_id long, xml string")))
    rows = nodes.collect()
    scopes = nodes.where("name = 'b'")
    inside = {(s.doc_id, s.pre, n.pre) for s in rows if s.name == "b" for n in rows if n.doc_id == s.doc_id and s.pre < n.pre <= s.post}
    got = nav.descendants(scopes, nodes).select("doc_id", "anc_pre", "pre").collect()
    assert {tuple(r) for r in got} == inside and len(got) == len(inside)
    want = {(d, s, p) for d, s, p in inside if any(n.doc_id == d and n.pre == p and n.name == "c" for n in rows)}
    assert {(r.doc_id, r.anc_pre, r.pre) for r in nav.select(scopes, nodes, ".//c").collect()} == want
    assert sorted((r.doc_id, r.pre, r.ns_uri) for r in nav.namespace_by_ancestor(nodes).collect()) == sorted((n.doc_id, n.pre, "") for n in rows if n.kind == "element")
