"""Queries on grammars: DTD, XML Schema, RelaxNG, catalogs, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import NODES
from ..operators import defaults as df
from ..operators import edit
from ..operators import identity as ident
from ..operators import navigate as nav
from ..operators import serialize as ser
from ..operators import validate as val
from ..operators.suite import schema_faults
from ..plans import wildcards as wild
from ..plans.assess import DtdGrammar, SchemaGrammar
from ..plans.catalog import Catalog, resolve_by_join
from ..plans.dtd import compile_dtd
from ..plans.lineage import stored
from ..plans.relaxng import RelaxNg
from ..plans.xsd import Schema, compile_schema, wildcard_allows
from ..plans.xsd_rules import BAD_EXAMPLES
from ..sources.tokenizer import nodes_of, parse
from . import synth
from .synth import element, table

# --- DTD

CONVERSATION_DTD = "<!ELEMENT conv (system?, (user, assistant?)+)><!ELEMENT system EMPTY><!ELEMENT user EMPTY><!ELEMENT assistant EMPTY>"
STRICT_DTD = CONVERSATION_DTD.replace("(system?, (user, assistant?)+)", "(system, (user, assistant)+)")
CUSTOMER_DTD = """
<!ENTITY % seg "seg (AUTOMOBILE|BUILDING|FURNITURE|MACHINERY) #IMPLIED">
<!ELEMENT customer (name, bal100)><!ELEMENT name (#PCDATA)><!ELEMENT bal100 (#PCDATA)>
<![INCLUDE[<!ATTLIST customer key NMTOKEN #REQUIRED %seg; kind CDATA "plain" code ID #IMPLIED>]]>
<![IGNORE[<!ATTLIST customer key CDATA #IMPLIED>]]>
"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a namespace: every fifth lacks its key, every seventh has an attribute ``x``, every ninth an element ``extra``."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    return c.select(
        key.alias("doc_id"),
        F.concat(F.lit("<customer"), F.when(key % 5 != 0, attr("key", key)).otherwise(""), attr("seg", F.col("c_mktsegment")), F.when(key % 7 == 0, F.lit(' x="1"')).otherwise(""), F.lit(">"), element("name", tx.escape_text(F.col("c_name"))), element("bal100", F.round(F.col("c_acctbal") * 100).cast("long")), F.when(key % 9 == 0, "<extra/>").otherwise(""), F.lit("</customer>")).alias("xml"),
    )


def dtd_content_model_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = stored(nodes_of(parse(synth.conversations(spark, sf_dir))))
    out = nodes.where("pre = 0").select("doc_id")
    for name, text in (("loose", CONVERSATION_DTD), ("strict", STRICT_DTD)):
        verdict = val.verdicts(nodes, val.dtd_violations(nodes, compile_dtd(text))).select("doc_id", F.col("is_valid").alias(name))
        out = out.join(verdict, "doc_id")
    return out.groupBy("loose", "strict").agg(F.count("*").alias("n"))


def dtd_violation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(parse(_customers(spark, sf_dir), grammar=DtdGrammar(), tasks=_tasks(spark)))
    return val.dtd_violations(nodes, compile_dtd(CUSTOMER_DTD)).groupBy("rule", "message").agg(F.count("*").alias("n"))


def dtd_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(parse(_customers(spark, sf_dir), grammar=DtdGrammar(), tasks=_tasks(spark)))
    first = val.first_violation(val.dtd_violations(nodes, compile_dtd(CUSTOMER_DTD)))
    return first.select(F.col("doc_id").alias("c_custkey"), "rule")


def dtd_default_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = compile_dtd(CUSTOMER_DTD)
    rules = {(None, a.element, a.name): a.default for a in grammar.attributes.values() if a.default is not None}
    nodes = df.merge_defaults(nodes_of(parse(_customers(spark, sf_dir))), df.default_table(spark, rules))
    root = nav.roots(nodes)
    return root.groupBy(tx.attribute(F.col("attrs"), "kind").alias("kind"), tx.has_attribute(F.col("attrs"), "key").alias("keyed")).agg(F.count("*").alias("n"))


def dtd_internal_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults and normalisation of an internal subset, while parsing."""
    n = table(spark, sf_dir, "nation")
    xml = F.concat(F.lit('<!DOCTYPE n [<!ATTLIST n kind CDATA "k" t NMTOKENS #IMPLIED>]><n t=" a  '), F.lower("n_name"), F.lit(' ">'), F.col("n_name"), F.lit("</n>"))
    root = nav.roots(nodes_of(parse(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.replace(xml, F.lit("_"), F.lit("-")).alias("xml")))))
    return root.select(F.col("doc_id").alias("n_nationkey"), tx.attribute(F.col("attrs"), "kind").alias("kind"), F.size(F.split(tx.attribute(F.col("attrs"), "t"), " ")).alias("tokens"))


def dtd_entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal entities (one inside another, one with mark-up) and an external one from the given texts."""
    r = table(spark, sf_dir, "region")
    xml = F.concat(F.lit('<!DOCTYPE r [<!ENTITY a "x&#38;amp;y"><!ENTITY b "[&a;]"><!ENTITY m "<i>m</i>"><!ENTITY e SYSTEM "ext:1">]><r>'), F.col("r_name"), F.lit("&b;&m;&e;</r>"))
    nodes = nodes_of(parse(r.select(F.col("r_regionkey").cast("long").alias("doc_id"), xml.alias("xml")), external={"ext:1": "outside"}))
    return nav.deep_text(nav.roots(nodes), nodes).select(F.col("doc_id").alias("r_regionkey"), "text")


def dtd_rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled grammar as a table, met with the documents: each attribute rule with the number of customers that give the attribute."""
    rules = compile_dtd(CUSTOMER_DTD).tables(spark)["dtd_attributes"]
    nodes = nodes_of(parse(_customers(spark, sf_dir), tasks=_tasks(spark)))
    given = nodes.where("kind = 'element'").select(F.col("name").alias("element"), F.explode("attrs.name").alias("attribute"))
    used = rules.join(given.groupBy("element", "attribute").agg(F.count("*").alias("n")), ["element", "attribute"], "left")
    return used.select("element", "attribute", "type", F.array_join("allowed", "|").alias("allowed"), "use", "default_value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grammar_merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grammars merged: what holds is the first's, where both declare; documents are judged by the merged one."""
    one = compile_dtd("<!ELEMENT a (b)><!ELEMENT b EMPTY><!ATTLIST a x CDATA 'one'>")
    two = compile_dtd("<!ELEMENT a (c)><!ELEMENT c (#PCDATA|b)*><!ATTLIST a x CDATA 'two' y CDATA 'y'>")
    merged = one.merged(two)
    xml = _variant(4, "<a><b/></a>", "<a><c/></a>", "<c>t<b/>t</c>", "<c><b>t</b></c>")
    nodes = nodes_of(parse(_by_customer(spark, sf_dir, xml), grammar=DtdGrammar(), tasks=_tasks(spark)))
    bad = val.dtd_violations(nodes, merged).select("doc_id", "rule")
    rules = {(None, a.element, a.name): a.default for a in merged.attributes.values() if a.default is not None}
    roots = nav.roots(df.merge_defaults(nodes.select(*NODES.fieldNames()), df.default_table(spark, rules)))
    told = roots.join(bad, "doc_id", "left").groupBy("doc_id", "name", *[tx.attribute(F.col("attrs"), a).alias(a) for a in ("x", "y")]).agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return told.groupBy((F.col("doc_id") % 4).alias("k"), "name", "x", "y", "rules").agg(F.count("*").alias("n"))


def id_idref_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = compile_dtd("<!ELEMENT parts (part*)><!ELEMENT part EMPTY><!ATTLIST part id ID #REQUIRED ref IDREF #IMPLIED>")
    nodes = nodes_of(parse(synth.parts(spark, sf_dir)))
    return val.dtd_violations(nodes, grammar, check_ids=True).select("doc_id", "rule", "message")


# --- XML Schema

ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:simpleType name="flag"><xs:restriction base="xs:token"><xs:enumeration value="A"/><xs:enumeration value="N"/></xs:restriction></xs:simpleType>
<xs:simpleType name="few"><xs:restriction base="xs:positiveInteger"><xs:maxInclusive value="45"/></xs:restriction></xs:simpleType>
<xs:complexType name="line"><xs:sequence><xs:element name="qty" type="few"/><xs:element name="price100" type="xs:unsignedInt"/></xs:sequence>
 <xs:attribute name="n" type="xs:positiveInteger" use="required"/><xs:attribute name="part" type="xs:integer"/><xs:attribute name="supp" type="xs:integer"/><xs:attribute name="flag" type="flag"/></xs:complexType>
<xs:element name="order"><xs:complexType><xs:sequence><xs:element name="line" type="line" minOccurs="0" maxOccurs="6"/></xs:sequence>
 <xs:attributeGroup ref="head"/></xs:complexType>
 <xs:unique name="lineNumber"><xs:selector xpath="line"/><xs:field xpath="@n"/></xs:unique></xs:element>
<xs:attributeGroup name="head"><xs:attribute name="key" type="xs:long" use="required"/><xs:attribute name="cust" type="xs:long" use="required"/><xs:attribute name="status" default="O"/></xs:attributeGroup>
</xs:schema>"""


def _schema(text: str) -> Schema:
    return compile_schema("s.xsd", {"s.xsd": text})


def _judged(docs: DataFrame, schema: Schema, tasks: int | None = None) -> DataFrame:
    """Violations of documents parsed with the schema at hand; kept where identity constraints read them again."""
    grammar = SchemaGrammar([schema])
    nodes = nodes_of(parse(docs, grammar=grammar, tasks=tasks))
    return val.xsd_violations(stored(nodes) if any(r.constraints for r in grammar.rules) else nodes, grammar)


def _tasks(spark: SparkSession) -> int:
    """Tables of documents in one file are dealt to all cores."""
    return 2 * spark.sparkContext.defaultParallelism


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(synth.orders(spark, sf_dir), _schema(ORDER_XSD))


def xsd_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too many lines, large quantities, a flag that isn't allowed, repeated line numbers."""
    return _violations(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


def violations_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).rollup("rule", "message").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


INNER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="d"><xs:complexType><xs:sequence>
<xs:element name="a"><xs:complexType><xs:sequence><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v" type="xs:integer"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
<xs:element name="b"><xs:complexType><xs:sequence><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="v" type="xs:NCName"/><xs:element name="w" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""


def xsd_types_of_one_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inner types with elements of one name: a number is right below ``a`` and wrong below ``b``, a word the other way round."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    value = lambda number: F.when(number, key.cast("string")).otherwise(F.col("c_mktsegment"))
    xml = F.concat(F.lit("<d><a><p><v>"), value(key % 3 != 0), F.lit("</v>"), F.when(key % 5 == 0, "<w/>").otherwise(""), F.lit("</p></a><b><p><v>"), value(key % 4 == 0), F.lit("</v><w/></p></b></d>"))
    found = _judged(c.select(key.alias("doc_id"), xml.alias("xml")), _schema(INNER_XSD))
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


def xsd_sequence_choice_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each customer, with children after its number; three models judge each."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    kids = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int")), lambda i: F.concat(F.lit("<"), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ((F.col("c_custkey") + i) % 3).cast("int")), F.lit("/>"))), "")
    out = c
    for name, model in (("seq", '<xs:sequence><xs:element name="a"/><xs:element name="b" minOccurs="0"/><xs:element name="c" minOccurs="0" maxOccurs="unbounded"/></xs:sequence>'), ("cho", '<xs:choice maxOccurs="3"><xs:element name="a"/><xs:element name="b"/></xs:choice>'), ("al", '<xs:all><xs:element name="a"/><xs:element name="b"/><xs:element name="c" minOccurs="0"/></xs:all>')):
        schema = _schema(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="d"><xs:complexType>{model}</xs:complexType></xs:element></xs:schema>')
        docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("<d>"), kids, F.lit("</d>")).alias("xml"))
        bad = _judged(docs, schema).where("pre = 0 and rule = 'content-model'").select(F.col("doc_id").alias("c_custkey"), F.lit(True).alias("bad"))
        out = out.join(bad, "c_custkey", "left").withColumn(name, F.col("bad").isNull()).drop("bad")
    return out.groupBy((F.col("c_custkey") % 12).alias("class"), "seq", "cho", "al").agg(F.count("*").alias("n"))


def xsd_wildcard_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of customers' documents beside five kinds of wildcard."""
    xml = _variant(3, "<e/>", '<e xmlns="urn:t"/>', '<o:e xmlns:o="urn:o"/>')
    spaces = nodes_of(parse(_by_customer(spark, sf_dir, xml), tasks=_tasks(spark))).groupBy(F.coalesce("ns_uri", F.lit("")).alias("ns")).agg(F.count("*").alias("n"))
    return spaces.select("ns", "n", *[wildcard_allows(w, F.col("ns"), "urn:t").alias(n) for n, w in (("any_", "##any"), ("other_", "##other"), ("local_", "##local"), ("target_", "##targetNamespace"), ("list_", "urn:o ##local"))])


_XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"'
_HOLDER = '<xs:element name="{0}"><xs:complexType>{1}</xs:complexType></xs:element>'
_ANY = '<xs:sequence><xs:any processContents="{0}" maxOccurs="unbounded"/></xs:sequence>'
CONTENTS_XSD = _XS + '><xs:element name="n" type="xs:int"/>' + _HOLDER.format("d", "<xs:sequence>" + "".join(_HOLDER.format(*p) for p in (("s", _ANY.format("strict")), ("l", _ANY.format("lax")), ("k", _ANY.format("skip")))) + "</xs:sequence>") + "</xs:schema>"
FOREIGN_XSD = _XS + ' xmlns="urn:t" targetNamespace="urn:t" elementFormDefault="qualified"><xs:attribute name="top" type="xs:int"/>' + _HOLDER.format("d", "<xs:sequence>" + "".join(_HOLDER.format(n, f'<xs:anyAttribute namespace="{w}" processContents="{p}"/>') for n, w, p in (("s", "##targetNamespace", "strict"), ("l", "##any", "lax"), ("k", "##other", "skip"))) + "</xs:sequence>") + "</xs:schema>"
BLOCK_XSD = _XS + """><xs:complexType name="base"><xs:attribute name="x" type="xs:int"/></xs:complexType><xs:complexType name="alien"/>
<xs:complexType name="ext"><xs:complexContent><xs:extension base="base"><xs:attribute name="y"/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="res"><xs:complexContent><xs:restriction base="base"><xs:attribute name="x" type="xs:byte"/></xs:restriction></xs:complexContent></xs:complexType>
<xs:element name="h" type="base" block="substitution"/><xs:element name="m" type="base" substitutionGroup="h"/>
<xs:element name="d"><xs:complexType><xs:sequence><xs:element name="a" type="base"/><xs:element name="b" type="base" block="extension"/><xs:element ref="h"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
LOCATED_XSD = {f"/x/{n}.xsd": f'{_XS}><xs:element name="r" type="xs:{t}"/></xs:schema>' for n, t in (("number", "int"), ("name", "NCName"))}


def _by_customer(spark: SparkSession, sf_dir: str, xml) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), xml.alias("xml"))


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("doc_id").alias("c_custkey"), "rule").agg(F.count("*").alias("n"))


def _variant(n: int, *texts: str):
    """One of the texts by the customer's number."""
    return F.get(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % n).cast("int"))


def xsd_process_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same elements below a strict, a lax and a skipping wildcard."""
    body = _variant(4, "<n>1</n>", "<n>x</n>", "<u><n>x</n></u>", '<u a="1"><w/></u>')
    xml = F.concat(F.lit("<d><s>"), body, F.lit("</s><l>"), body, F.lit("</l><k>"), body, F.lit("</k></d>"))
    return _counted(_judged(_by_customer(spark, sf_dir, xml), _schema(CONTENTS_XSD)))


def xsd_attribute_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same attribute below three wildcards; one prefix is bound further up."""
    given = _variant(4, ' t:top="5"', ' t:top="x"', ' o:y="1"', ' t:none="1"')
    xml = F.concat(F.lit('<t:d xmlns:t="urn:t" xmlns:o="urn:o"><t:s'), given, F.lit("/><t:l"), given, F.lit("/><t:k"), given, F.lit("/></t:d>"))
    return _counted(_judged(_by_customer(spark, sf_dir, xml), _schema(FOREIGN_XSD)))


def xsd_blocked_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types named by instances: derived or not, by a blocked method or not; a substitute that its head shuts out."""
    given = _variant(4, "", ' xsi:type="ext"', ' xsi:type="res"', ' xsi:type="alien"')
    xml = F.concat(F.lit('<d xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><a'), given, F.lit("/><b"), given, F.lit("/>"), _variant(3, "<m/>", "<h/>", "<h/>"), F.lit("</d>"))
    return _counted(_judged(_by_customer(spark, sf_dir, xml), _schema(BLOCK_XSD)))


def xsd_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document judged by the schema that it names; some name none, some one that isn't there."""
    key = F.col("c_custkey")
    where = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(' xsi:noNamespaceSchemaLocation="/x/'), F.when(key % 5 == 0, "gone").when(key % 2 == 0, "name").otherwise("number"), F.lit('.xsd"')))
    xml = F.concat(F.lit('<r xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'), where, F.lit(">"), F.when(key % 3 == 0, key.cast("string")).otherwise(F.col("c_mktsegment")), F.lit("</r>"))
    return _counted(val.violations_by_location(stored(nodes_of(parse(_by_customer(spark, sf_dir, xml)))), LOCATED_XSD.__getitem__))


def xsd_default_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType><xs:sequence><xs:element name="name" default="nobody"/><xs:element name="bal100"/></xs:sequence><xs:attribute name="seg" default="NONE"/><xs:attribute name="v" fixed="1"/></xs:complexType></xs:element></xs:schema>')
    c = table(spark, sf_dir, "customer")
    odd = F.col("c_custkey") % 2 == 1
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("<customer"), F.when(odd, F.concat(F.lit(' seg="'), F.col("c_mktsegment"), F.lit('"'))).otherwise(""), F.lit("><name>"), F.when(odd, F.col("c_name")).otherwise(""), F.lit("</name><bal100>0</bal100></customer>")).alias("xml"))
    nodes = df.merge_defaults(nodes_of(parse(docs)), df.default_table(spark, schema.attribute_defaults()))
    texts = spark.createDataFrame([(r.name, r.default) for r in schema.elements() if r.default], "element string, default_text string")
    names = df.insert_text_defaults(nodes, texts).where("name = 'name'").select("doc_id", "text")
    return nav.roots(nodes).join(names, "doc_id").select(F.col("doc_id").alias("c_custkey"), tx.attribute(F.col("attrs"), "seg").alias("seg"), tx.attribute(F.col("attrs"), "v").alias("v"), F.col("text").alias("name"))


def xsd_union_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="small"><xs:restriction base="xs:integer"><xs:maxInclusive value="20"/></xs:restriction></xs:simpleType><xs:simpleType name="word"><xs:restriction base="xs:token"><xs:pattern value="[a-z]+"/></xs:restriction></xs:simpleType><xs:simpleType name="either"><xs:union memberTypes="small word"/></xs:simpleType><xs:simpleType name="words"><xs:list itemType="word"/></xs:simpleType><xs:simpleType name="two"><xs:restriction base="words"><xs:length value="2"/></xs:restriction></xs:simpleType></xs:schema>')
    kind = lambda n: schema.type(("", n))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lower("p_name")).alias("v"))
    return p.select("p_partkey", "v", kind("either").accepts(F.col("v")).alias("either"), kind("either").member_of(F.col("v")).alias("member"), kind("words").accepts(F.col("v")).alias("words"), kind("two").accepts(F.col("v")).alias("two"))


def xsd_xsi_type_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="base"><xs:sequence><xs:element name="a" type="xs:int" nillable="true"/></xs:sequence></xs:complexType><xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:sequence><xs:element name="b" type="xs:int"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType><xs:element name="d" type="base"/><xs:element name="m" type="more"/></xs:schema>')
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey") % 6
    body = F.when(k == 0, "<d><a>1</a></d>").when(k == 1, "<d><a>1</a><b>2</b></d>").when(k == 2, '<d xsi:type="more"><a>1</a><b>2</b></d>').when(k == 3, '<d><a xsi:nil="true"/></d>').when(k == 4, '<d><a xsi:nil="true">1</a></d>').otherwise('<d xsi:nil="true"/>')
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.regexp_replace(body, "^<d", '<d xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"').alias("xml"))
    bad = _judged(docs, schema)
    return bad.groupBy((F.col("doc_id") % 6).alias("k"), "rule").agg(F.count("*").alias("n"))


SUBSTITUTION_XSD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="h" abstract="true"/><xs:element name="a" substitutionGroup="h"/><xs:element name="b" substitutionGroup="a"/><xs:element name="c" substitutionGroup="b"/><xs:element name="z"/><xs:element name="d"><xs:complexType><xs:sequence><xs:element ref="h" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>'


def substitution_group_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by a recursive query over the declarations, beside the compiler's; with the number of documents in which each stands for a head."""
    schema = _schema(SUBSTITUTION_XSD)
    heads = f"heads_{uuid.uuid4().hex}"
    spark.createDataFrame([(n[1], r.head[1] if r.head else None) for n, r in schema.globals.items()], "name string, head string").createOrReplaceTempView(heads)
    found = spark.sql(f"with recursive m(head, name, steps) as (select name, name, 0 from {heads} union all select m.head, h.name, m.steps + 1 from m join {heads} h on h.head = m.name) select head, name, steps from m")
    known = spark.createDataFrame([(h[1], n[1]) for h in schema.globals for n in schema.members(h)], "head string, name string").withColumn("usable", F.lit(True))
    xml = F.concat(F.lit("<d>"), _variant(5, "<a/>", "<b/>", "<c/>", "<z/>", "<h/>"), F.lit("</d>"))
    grammar = SchemaGrammar([schema])
    nodes = nodes_of(parse(_by_customer(spark, sf_dir, xml), grammar=grammar, tasks=_tasks(spark)))
    wrong = val.xsd_violations(nodes, grammar).where("pre = 0").select("doc_id").distinct()
    stands = nodes.where("level = 1").join(wrong, "doc_id", "left_anti").groupBy("name").agg(F.count("*").alias("n")).withColumn("head", F.lit("h"))
    out = found.join(F.broadcast(known), ["head", "name"], "left").join(stands, ["head", "name"], "left")
    return out.select("head", "name", F.col("steps").cast("int").alias("steps"), F.coalesce("usable", F.lit(False)).alias("usable"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def xsd_schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema document for each supplier and part, by its number one of those that break a rule; the rules found."""
    names = sorted(BAD_EXAMPLES)
    key = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_suppkey"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(names)).cast("int"))
    judged = key.select(of(names).alias("example"), schema_faults(of([BAD_EXAMPLES[n] for n in names])).alias("faults"))
    return judged.select("example", F.explode(F.array_distinct(F.transform("faults", lambda f: f["rule"]))).alias("rule")).groupBy("example", "rule").agg(F.count("*").alias("n"))


def xsd_native_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines judged by the engine, counted beside plain conversions of the same values."""
    flags = _schema(ORDER_XSD).type(("", "flag"))
    few = _schema(ORDER_XSD).type(("", "few"))
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(flags.accepts(F.col("l_returnflag")).alias("flag_ok"), few.accepts(F.col("l_quantity").cast("long").cast("string")).alias("qty_ok")).agg(F.count("*").alias("n"))


# --- identity

def identity_unique_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = stored(nav.elements(nodes_of(parse(synth.orders(spark, sf_dir)))))
    rows = ident.tuples(nav.roots(nodes), nodes, "line", ["@n"])
    return ident.repeated(rows).select(F.col("doc_id").alias("l_orderkey"), F.col("f0").cast("int").alias("l_linenumber"), "n")


def identity_key_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of part and quantity: repeated and incomplete tuples."""
    nodes = stored(nodes_of(parse(synth.orders(spark, sf_dir))))
    rows = ident.tuples(nav.roots(nodes), nodes, "./line", ["@part", "qty", "@none"]).drop("f2")
    missing = ident.incomplete(ident.tuples(nav.roots(nodes), nodes, "./line", ["@part", "@none"]))
    return ident.repeated(rows).agg(F.count("*").alias("repeated")).crossJoin(F.broadcast(missing.agg(F.count("*").alias("incomplete"))))


def identity_keyref_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each nation-sized block: orders whose customer isn't in the document (every fourth is left out)."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc_id"), F.concat(F.lit('<o c="'), F.col("o_custkey").cast("string"), F.lit('"/>')).alias("x"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 != 0").select((F.col("c_custkey") % 100).alias("doc_id"), F.concat(F.lit('<c k="'), F.col("c_custkey").cast("string"), F.lit('"/>')).alias("x"))
    docs = o.union(c).groupBy("doc_id").agg(F.concat(F.lit("<db>"), F.array_join(F.collect_list("x"), ""), F.lit("</db>")).alias("xml"))
    nodes = nodes_of(parse(docs))
    roots = nav.roots(nodes)
    bad = ident.unmatched(ident.tuples(roots, nodes, "o", ["@c"]), ident.tuples(roots, nodes, "c", ["@k"]))
    return bad.groupBy(F.col("f0").cast("long").alias("o_custkey")).agg(F.count("*").alias("n"))


# --- catalogs and RelaxNG

CATALOGS = {
    "/c/main.xml": """<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog" prefer="public"><rewriteURI uriStartString="http://" rewritePrefix="web/"/><rewriteURI uriStartString="http://www." rewritePrefix="www/"/>
<uriSuffix uriSuffix="/1" uri="one"/><uriSuffix uriSuffix="#top" uri="top"/><public publicId="-//T//DTD X//EN" uri="x.dtd"/><delegatePublic publicIdStartString="-//D" catalog="deep.xml"/><system systemId="urn:s" uri="s.dtd"/>
<systemSuffix systemIdSuffix=".dtd" uri="any.dtd"/><group xml:base="sub"><public publicId="-//T//DTD Y//EN" uri="y.dtd"/></group><nextCatalog catalog="next.xml"/></catalog>""",
    "/c/deep.xml": '<catalog><public publicId="-//D//One//EN" uri="d1.dtd"/></catalog>',
    "/c/next.xml": '<catalog><public publicId="-//T//DTD X//EN" uri="late.dtd"/><public publicId="-//T//DTD Z//EN" uri="z.dtd"/></catalog>',
}


def _catalog() -> Catalog:
    return Catalog("/c/main.xml", CATALOGS.__getitem__)


def catalog_rewrite_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rewrite prefix of each page's address."""
    entries = _catalog().table(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = resolve_by_join(pages, entries, "rewriteURI", "url")
    return found.select("page_id", F.concat("target", F.expr("substring(url, length(entry) + 1)")).alias("target"))


def catalog_suffix_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", _catalog().match_uri(F.col("url")).alias("target"))


def catalog_delegate_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public and system identifiers of customers' documents, resolved by a catalog that delegates, groups and chains."""
    ids = [("-//T//DTD X//EN", "urn:s"), ("-//T//DTD Y//EN", ""), ("-//T//DTD Z//EN", ""), ("-//D//One//EN", ""), ("-//D//Two//EN", ""), ("urn:publicid:-:T:DTD+X:EN", ""), ("none", "a/b.dtd"), ("none", "urn:s"), ("none", "x/none")]
    xml = F.concat(F.lit('<!DOCTYPE c PUBLIC "'), _variant(9, *[p for p, _ in ids]), F.lit('" "'), _variant(9, *[s for _, s in ids]), F.lit('"><c/>'))
    doctypes = nodes_of(parse(_by_customer(spark, sf_dir, xml), tasks=_tasks(spark))).where("kind = 'doctype'")
    rows = doctypes.groupBy(*[tx.attribute(F.col("attrs"), n).alias(n) for n in ("public_id", "system_id")]).agg(F.count("*").alias("n"))
    c = _catalog()
    return rows.select("public_id", "system_id", "n", c.match_public(F.col("public_id")).alias("public"), c.match_system(F.col("system_id")).alias("system"), c.resolve_entity(F.col("public_id"), F.col("system_id")).alias("entity"))


LIBRARY_RNG = {
    "/g/main.rng": """<grammar xmlns="http://relaxng.org/ns/structure/1.0" xmlns:a="http://relaxng.org/ns/compatibility/annotations/1.0"><start><ref name="lib"/></start><include href="more.rng"/>
<div><define name="lib"><element name="customer"><optional><attribute name="region" a:defaultValue="global"/></optional><ref name="extra"/><a:documentation>text</a:documentation><zeroOrMore><ref name="name"/></zeroOrMore></element></define></div>
<define name="name"><element><choice><name>name</name><name>bal100</name></choice><attribute name="lang" a:defaultValue="en"/></element></define></grammar>""",
    "/g/more.rng": '<grammar xmlns="http://relaxng.org/ns/structure/1.0" xmlns:d="http://relaxng.org/ns/compatibility/annotations/1.0"><define name="extra"><attribute name="seg" d:defaultValue="NONE"/></define></grammar>',
}


def rng_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = RelaxNg("/g/main.rng", LIBRARY_RNG.__getitem__)
    docs = _customers(spark, sf_dir)
    nodes = df.merge_defaults(nodes_of(parse(docs)), df.default_table(spark, grammar.defaults))
    return nav.elements(nodes).where("name != 'extra'").groupBy("name", *[tx.attribute(F.col("attrs"), a).alias(a) for a in ("region", "lang")], tx.has_attribute(F.col("attrs"), "seg").alias("seg")).agg(F.count("*").alias("n"))


def default_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with a namespace before one without, an earlier grammar before a later."""
    first = {(None, "customer", "p"): "dtd", (None, "customer", "q"): "dtd"}
    second = {("urn:c", "customer", "p"): "xsd", ("urn:c", "customer", "r"): "xsd", ("urn:x", "customer", "s"): "never"}
    nodes = df.merge_defaults(nodes_of(parse(synth.customers(spark, sf_dir))), df.default_table(spark, first, second))
    return nav.roots(nodes).groupBy(*[tx.attribute(F.col("attrs"), a).alias(a) for a in ("p", "q", "r", "s")]).agg(F.count("*").alias("n"))


def schema_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    xml = F.concat(F.lit('<r xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="urn:a a.xsd  urn:'), F.col("r_regionkey").cast("string"), F.lit(' b.xsd" xsi:noNamespaceSchemaLocation="n.xsd"/>'))
    found = val.schema_locations(nodes_of(parse(r.select(F.col("r_regionkey").cast("long").alias("doc_id"), xml.alias("xml")))))
    return found.groupBy("ns", "location").agg(F.count("*").alias("n"))


def rng_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammars that documents name in ``xml-model`` instructions, without Python on the rows."""
    r = table(spark, sf_dir, "region")
    xml = F.concat(F.lit('<?xml-model href="g'), (F.col("r_regionkey") % 2).cast("string"), F.lit('.rng" type="application/xml"?><r/>'))
    nodes = nodes_of(parse(r.select(F.col("r_regionkey").cast("long").alias("doc_id"), xml.alias("xml"))))
    data = nav.first_instruction(nodes, "xml-model")
    return data.groupBy(F.regexp_extract("data", r"""href=["']([^"']*)""", 1).alias("href")).agg(F.count("*").alias("n"))


def wildcard_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of wildcards, with the numbers of customers' elements that each covers."""
    tokens = ["##any", "##other", "##local urn:a", "##targetNamespace urn:b"]
    xml = _variant(4, "<e/>", '<e xmlns="urn:t"/>', '<e xmlns="urn:a"/>', '<e xmlns="urn:b"/>')
    spaces = nodes_of(parse(_by_customer(spark, sf_dir, xml), tasks=_tasks(spark))).groupBy(F.coalesce("ns_uri", F.lit("")).alias("ns")).agg(F.count("*").alias("n"))
    rows = []
    for a in tokens:
        for b in tokens:
            x, y = wild.parse(a, "urn:t"), wild.parse(b, "urn:t")
            both, either = wild.intersection(x, y), wild.union(x, y)
            rows.append((a, b, wild.shown(both), wild.shown(either), wild.is_subset(x, y), both[0], sorted(both[1]) if len(both) > 1 else [], either[0], sorted(either[1]) if len(either) > 1 else []))
    names = ("a", "b", "both", "either", "inside", "b_form", "b_spaces", "e_form", "e_spaces")
    as_column = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
    pairs = F.array(*[F.struct(*[as_column(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    covers = lambda side: F.when(F.col(f"{side}_form") == "any", F.lit(True)).when(F.col(f"{side}_form") == "not", ~F.array_contains(f"{side}_spaces", F.col("ns"))).otherwise(F.array_contains(f"{side}_spaces", F.col("ns")))
    met = spaces.select("ns", "n", F.inline(pairs))
    count = lambda side: F.coalesce(F.sum(F.when(covers(side), F.col("n"))), F.lit(0)).cast("long")
    return met.groupBy("a", "b", "both", "either", "inside").agg(count("b").alias("n_both"), count("e").alias("n_either"))


def type_derivation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of each type with the methods on the way, by a recursive query over the compiled derivations; with the number of instances that name the type and are valid."""
    derived = '<xs:complexType name="{0}"><xs:complexContent><xs:{2} base="{1}"/></xs:complexContent></xs:complexType>'
    schema = _schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="a"/>' + "".join(derived.format(*d) for d in (("b", "a", "extension"), ("c", "b", "restriction"), ("d", "a", "restriction"))) + '<xs:element name="e" type="a" block="extension"/></xs:schema>')
    steps = f"derivation_{uuid.uuid4().hex}"
    spark.createDataFrame(schema.derivation(), "type string, base string, method string").createOrReplaceTempView(steps)
    closed = spark.sql(f"with recursive up(type, ancestor, methods) as (select type, base, method from {steps} union all select u.type, d.base, concat(u.methods, ',', d.method) from up u join {steps} d on d.type = u.ancestor) select type, ancestor, methods, contains(methods, 'extension') as by_extension from up")
    xml = F.concat(F.lit('<e xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:type="'), _variant(4, "a", "b", "c", "d"), F.lit('"/>'))
    grammar = SchemaGrammar([schema])
    nodes = nodes_of(parse(_by_customer(spark, sf_dir, xml), grammar=grammar, tasks=_tasks(spark)))
    valid = nodes.join(val.xsd_violations(nodes, grammar).select("doc_id").distinct(), "doc_id", "left_anti").groupBy(F.col("xsi_type").alias("type")).agg(F.count("*").alias("n"))
    return closed.join(valid, "type", "left").select("type", "ancestor", "methods", "by_extension", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def value_space_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed value is compared as a value: 1, 1.0 and +01.00 are one decimal."""
    schema = _schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="v" type="xs:decimal" fixed="1.0"/></xs:schema>')
    xml = F.concat(F.lit("<v>"), _variant(5, "1", "1.0", "+01.00", "1.01", "-1"), F.lit("</v>"))
    return _counted(_judged(_by_customer(spark, sf_dir, xml), schema, _tasks(spark)))


def append_and_remove_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add a comment and an element, then remove the first region element that equals a given one."""
    n = table(spark, sf_dir, "nation")
    xml = F.concat(F.lit("<n><name>"), F.col("n_name"), F.lit('</name><r k="'), F.col("n_regionkey").cast("string"), F.lit('" a="1"/><r a="1" k="2"/></n>'))
    nodes = stored(nodes_of(parse(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), xml.alias("xml")))))
    more = edit.append_child(nodes, F.col("level") == 0, "comment", None, F.lit("added"))
    more = stored(edit.append_child(more, F.col("level") == 0, "element", F.lit("e"), None))
    given = nodes_of(parse(spark.createDataFrame([(0, '<r a="1" k="2"/>')], "doc_id long, xml string")))
    left = edit.remove_first_equal(more, more.where("path = '/n/r' and kind = 'element'"), given)
    return ser.to_text(left).select(F.col("doc_id").alias("n_nationkey"), "xml")


QUERIES = {f.__name__: f for f in (
    dtd_content_model_conversations, dtd_violation_rules, dtd_first_violation, dtd_default_merge, dtd_internal_defaults, dtd_entity_expansion, dtd_rule_tables,
    grammar_merge_keep_first, id_idref_parts, xsd_order_violations, violations_rollup, xsd_types_of_one_name, xsd_process_contents, xsd_attribute_wildcards, xsd_blocked_types, xsd_by_location, xsd_sequence_choice_all, xsd_wildcard_namespaces, xsd_default_fixed,
    xsd_union_list, xsd_xsi_type_nil, substitution_group_closure, xsd_schema_rules, xsd_native_differential, identity_unique_lineitem, identity_key_lineitem,
    identity_keyref_orders_customer, catalog_rewrite_pages, catalog_suffix_pages, catalog_delegate_public, rng_defaults, default_precedence, schema_locations, rng_references, wildcard_algebra, type_derivation_closure,
    value_space_fixed, append_and_remove_children,
)}

_O, _A, _B = "not:|urn:t", "in:|urn:a", "in:urn:b|urn:t"
_ALGEBRA = [
    ("##any", "##any", "any", "any", True), ("##any", "##other", _O, "any", False), ("##any", "##local urn:a", _A, "any", False), ("##any", "##targetNamespace urn:b", _B, "any", False),
    ("##other", "##any", _O, "any", True), ("##other", "##other", _O, _O, True), ("##other", "##local urn:a", "in:urn:a", "not:urn:t", False), ("##other", "##targetNamespace urn:b", "in:urn:b", "not:", False),
    ("##local urn:a", "##any", _A, "any", True), ("##local urn:a", "##other", "in:urn:a", "not:urn:t", False), ("##local urn:a", "##local urn:a", _A, _A, True), ("##local urn:a", "##targetNamespace urn:b", "in:", "in:|urn:a|urn:b|urn:t", False),
    ("##targetNamespace urn:b", "##any", _B, "any", True), ("##targetNamespace urn:b", "##other", "in:urn:b", "not:", False), ("##targetNamespace urn:b", "##local urn:a", "in:", "in:|urn:a|urn:b|urn:t", False), ("##targetNamespace urn:b", "##targetNamespace urn:b", _B, _B, True),
]
_COVERS = "{0} = 'any' or (starts_with({0}, 'not:') and not list_contains(string_split({0}[5:], '|'), ns)) or (starts_with({0}, 'in:') and {0} != 'in:' and list_contains(string_split({0}[4:], '|'), ns))"
_ROLES = "(select conv_id, string_agg(role, ' ' order by turn, role) || ' ' as s from conversations group by 1)"
_LINES = "select l.* from lineitem l join orders o on o.o_orderkey = l.l_orderkey"
_KIDS = "(select c_custkey, list_aggregate([['a', 'b', 'c'][cast((c_custkey + i) % 3 as integer) + 1] for i in range(0, c_custkey % 4 + 1)], 'string_agg', '') as s from customer)"
_RULES = f"""select 'content-model' as rule, 'children don''t match in order' as message, l_orderkey as doc from ({_LINES}) group by l_orderkey having count(*) > 6
union all select 'value-type', 'bad value of qty', l_orderkey from ({_LINES}) where l_quantity > 45
union all select 'attribute-type', 'bad value for attribute flag of line', l_orderkey from ({_LINES}) where l_returnflag not in ('A', 'N')"""
ORACLES = {
    "dtd_content_model_conversations": f"select regexp_full_match(s, '(system )?(user (assistant )?)+') as loose, regexp_full_match(s, 'system (user assistant )+') as strict, count(*) as n from {_ROLES} group by 1, 2",
    "dtd_violation_rules": "select rule, message, count(*) as n from customer, (values ('attribute-required', 'missing attribute key of customer'), ('attribute-undeclared', 'undeclared attribute x of customer'), ('attribute-type', 'bad value for attribute seg of customer'), ('content-model', 'content of customer doesn''t match'), ('element-undeclared', 'undeclared element extra')) v(rule, message) where case rule when 'attribute-required' then c_custkey % 5 = 0 when 'attribute-undeclared' then c_custkey % 7 = 0 when 'attribute-type' then c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') else c_custkey % 9 = 0 end group by 1, 2",
    "dtd_first_violation": "select c_custkey, rule from (select c_custkey, case when c_custkey % 5 = 0 then 'attribute-required' when c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') then 'attribute-type' when c_custkey % 7 = 0 then 'attribute-undeclared' when c_custkey % 9 = 0 then 'content-model' end as rule from customer) where rule is not null",
    "dtd_default_merge": "select 'plain' as kind, c_custkey % 5 != 0 as keyed, count(*) as n from customer group by 1, 2",
    "dtd_internal_defaults": "select n_nationkey::bigint as n_nationkey, 'k' as kind, cast(1 + len(list_filter(string_split(n_name, ' '), lambda x: x != '')) as integer) as tokens from nation",
    "dtd_entity_expansion": "select r_regionkey::bigint as r_regionkey, r_name || '[x&y]moutside' as text from region",
    "dtd_rule_tables": "select x.*, case attribute when 'key' then (select count(*) from customer where c_custkey % 5 != 0) when 'seg' then (select count(*) from customer) else 0 end as n from (values ('customer', 'key', 'NMTOKEN', '', 'required', null), ('customer', 'seg', 'ENUMERATION', 'AUTOMOBILE|BUILDING|FURNITURE|MACHINERY', 'implied', null), ('customer', 'kind', 'CDATA', '', 'optional', 'plain'), ('customer', 'code', 'ID', '', 'implied', null)) x(element, attribute, type, allowed, use, default_value)",
    "grammar_merge_keep_first": "select c_custkey % 4 as k, name, x, y, rules, count(*) as n from customer join (values (0, 'a', 'one', 'y', ''), (1, 'a', 'one', 'y', 'content-model'), (2, 'c', null, null, ''), (3, 'c', null, null, 'content-empty')) v(m, name, x, y, rules) on c_custkey % 4 = m group by all",
    "id_idref_parts": "select p_partkey // 1000 as doc_id, 'idref-dangling' as rule, 'no ID p' || (p_partkey + 1) as message from part p where not exists (select 1 from part q where q.p_partkey = p.p_partkey + 1 and q.p_partkey // 1000 = p.p_partkey // 1000)",
    "xsd_order_violations": f"select rule, count(*) as n from ({_RULES} union all select 'unique', '', l_orderkey from (select l_orderkey, l_linenumber from ({_LINES}) group by 1, 2 having count(*) > 1)) group by 1",
    "violations_rollup": f"select rule, message, count(*) as n, count(distinct doc) as docs from ({_RULES} union all select 'unique', 'repeated value of lineNumber', l_orderkey from (select l_orderkey, l_linenumber from ({_LINES}) group by 1, 2 having count(*) > 1)) group by rollup (rule, message)",
    "xsd_types_of_one_name": "select c_custkey, 'value-type' as rule, cast((c_custkey % 3 = 0)::int + (c_custkey % 4 = 0)::int as bigint) as n from customer where c_custkey % 3 = 0 or c_custkey % 4 = 0 union all select c_custkey, r, 1 from customer, (values ('content-model'), ('element-undeclared')) v(r) where c_custkey % 5 = 0",
    "xsd_process_contents": "select c_custkey, rule, n::bigint as n from customer, (values (1, 'value-type', 2), (2, 'element-undeclared', 1), (2, 'value-type', 2), (3, 'element-undeclared', 2)) v(m, rule, n) where c_custkey % 4 = m",
    "xsd_attribute_wildcards": "select c_custkey, rule, n::bigint as n from customer, (values (0, 'attribute-undeclared', 1), (1, 'attribute-type', 2), (1, 'attribute-undeclared', 1), (2, 'attribute-undeclared', 1), (3, 'attribute-undeclared', 2)) v(m, rule, n) where c_custkey % 4 = m",
    "xsd_blocked_types": "select c_custkey, 'type-blocked' as rule, case c_custkey % 4 when 1 then 1 else 2 end::bigint as n from customer where c_custkey % 4 in (1, 3) union all select c_custkey, 'content-model', 1 from customer where c_custkey % 3 = 0",
    "xsd_by_location": "select c_custkey, case when c_custkey % 5 = 0 then 'schema-missing' else 'value-type' end as rule, 1::bigint as n from customer where c_custkey % 7 != 0 and (c_custkey % 5 = 0 or (c_custkey % 2 = 0) = (c_custkey % 3 = 0))",
    "xsd_sequence_choice_all": f"select c_custkey % 12 as class, regexp_full_match(s, 'ab?c*') as seq, regexp_full_match(s, '[ab]{{1,3}}') as cho, contains(s, 'a') and contains(s, 'b') and length(s) = len(list_distinct(string_split(s, ''))) as al, count(*) as n from {_KIDS} group by 1, 2, 3, 4",
    "xsd_wildcard_namespaces": "select x.* exclude (k), (select count(*) from customer where c_custkey % 3 = k) as n from (values (0, '', true, false, true, false, true), (1, 'urn:t', true, false, false, true, false), (2, 'urn:o', true, true, false, false, true)) x(k, ns, any_, other_, local_, target_, list_)",
    "xsd_default_fixed": "select c_custkey, case when c_custkey % 2 = 1 then c_mktsegment else 'NONE' end as seg, '1' as v, case when c_custkey % 2 = 1 then c_name else 'nobody' end as name from customer",
    "xsd_union_list": "select p_partkey, v, e1 or e2 as either, case when e1 then 'small' when e2 then 'word' end as member, w as words, w and n = 2 as two from (select p_partkey, v, coalesce(try_cast(v as integer) <= 20, false) as e1, regexp_full_match(v, '[a-z]+') as e2, regexp_full_match(v, '[a-z]+( [a-z]+)*') as w, len(string_split(v, ' ')) as n from (select p_partkey, case when p_partkey % 2 = 0 then cast(p_size as varchar) else lower(p_name) end as v from part))",
    "xsd_xsi_type_nil": "select c_custkey % 6 as k, rule, count(*) as n from customer, (values (1, 'content-model'), (1, 'element-undeclared'), (4, 'nil-content'), (5, 'nil-not-allowed')) v(m, rule) where c_custkey % 6 = m group by 1, 2",
    "substitution_group_closure": "select head, name, steps, usable, case when head = 'h' and name in ('a', 'b', 'c') then (select count(*) from customer where c_custkey % 5 = case name when 'a' then 0 when 'b' then 1 else 2 end) else 0 end as n from (values ('h', 'h', 0, false), ('h', 'a', 1, true), ('h', 'b', 2, true), ('h', 'c', 3, true), ('a', 'a', 0, true), ('a', 'b', 1, true), ('a', 'c', 2, true), ('b', 'b', 0, true), ('b', 'c', 1, true), ('c', 'c', 0, true), ('z', 'z', 0, true), ('d', 'd', 0, true)) x(head, name, steps, usable)",
    "xsd_native_differential": "select l_returnflag in ('A', 'N') as flag_ok, l_quantity between 1 and 45 as qty_ok, count(*) as n from lineitem group by 1, 2",
    "xsd_schema_rules": "select example, example as rule, count(*) as n from (select [" + ", ".join(f"'{r}'" for r in sorted(BAD_EXAMPLES)) + f"][cast(k % {len(BAD_EXAMPLES)} as int) + 1] as example from (select p_partkey as k from part union all select s_suppkey from supplier)) group by 1",
    "identity_unique_lineitem": f"select l_orderkey, l_linenumber, count(*) as n from ({_LINES}) group by 1, 2 having count(*) > 1",
    "identity_key_lineitem": f"select (select count(*) from (select 1 from ({_LINES}) group by l_orderkey, l_partkey, l_quantity having count(*) > 1)) as repeated, (select count(*) from ({_LINES})) as incomplete",
    "identity_keyref_orders_customer": "select o_custkey, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey % 4 != 0) group by 1",
    "catalog_rewrite_pages": "select page_id, case when starts_with(url, 'http://www.') then 'www/' || url[12:] when starts_with(url, 'http://') then 'web/' || url[8:] end as target from pages",
    "catalog_suffix_pages": "select page_id, case when ends_with(url, '#top') then '/c/top' when ends_with(url, '/1') then '/c/one' end as target from pages",
    "catalog_delegate_public": "select x.* exclude (k), (select count(*) from customer where c_custkey % 9 = k) as n from (values (0, '-//T//DTD X//EN', 'urn:s', '/c/x.dtd', '/c/s.dtd', '/c/x.dtd'), (1, '-//T//DTD Y//EN', '', '/c/sub/y.dtd', null, '/c/sub/y.dtd'), (2, '-//T//DTD Z//EN', '', '/c/z.dtd', null, '/c/z.dtd'), (3, '-//D//One//EN', '', '/c/d1.dtd', null, '/c/d1.dtd'), (4, '-//D//Two//EN', '', null, null, null), (5, 'urn:publicid:-:T:DTD+X:EN', '', '/c/x.dtd', null, '/c/x.dtd'), (6, 'none', 'a/b.dtd', null, '/c/any.dtd', '/c/any.dtd'), (7, 'none', 'urn:s', null, '/c/s.dtd', '/c/s.dtd'), (8, 'none', 'x/none', null, null, null)) x(k, public_id, system_id, \"public\", \"system\", entity)",
    "rng_defaults": "select name, region, lang, seg, count(*) as n from customer, (values ('customer', 'global', null, true), ('name', null, 'en', false), ('bal100', null, 'en', false)) v(name, region, lang, seg) group by 1, 2, 3, 4",
    "default_precedence": "select 'dtd' as p, 'dtd' as q, 'xsd' as r, cast(null as varchar) as s, count(*) as n from customer",
    "rng_references": "select 'g' || (r_regionkey % 2) || '.rng' as href, count(*) as n from region group by 1",
    "wildcard_algebra": "with spaces as (select ['', 'urn:t', 'urn:a', 'urn:b'][cast(c_custkey % 4 as int) + 1] as ns, count(*) as n from customer group by 1), algebra as (select * from (values " + ", ".join(f"('{a}', '{b}', '{x}', '{y}', {z})" for a, b, x, y, z in _ALGEBRA) + ") x(a, b, \"both\", either, inside)) select a, b, \"both\", either, inside, cast(coalesce(sum(n) filter (" + _COVERS.format('"both"') + "), 0) as bigint) as n_both, cast(coalesce(sum(n) filter (" + _COVERS.format("either") + "), 0) as bigint) as n_either from algebra, spaces group by all",
    "type_derivation_closure": "select x.*, case type when 'd' then (select count(*) from customer where c_custkey % 4 = 3) else 0 end as n from (values ('b', 'a', 'extension', true), ('c', 'b', 'restriction', false), ('c', 'a', 'restriction,extension', true), ('d', 'a', 'restriction', false)) x(type, ancestor, methods, by_extension)",
    "value_space_fixed": "select c_custkey, 'value-fixed' as rule, 1::bigint as n from customer where c_custkey % 5 >= 3",
    "append_and_remove_children": """select n_nationkey::bigint as n_nationkey, '<n><name>' || n_name || '</name>' || case when n_regionkey = 2 then '' else '<r k="' || n_regionkey || '" a="1"/>' end || case when n_regionkey = 2 then '<r a="1" k="2"/>' else '' end || '<!--added--><e/></n>' as xml from nation""",
    "schema_locations": "select 'urn:a' as ns, 'a.xsd' as location, count(*) as n from region union all select '', 'n.xsd', count(*) from region union all select 'urn:' || r_regionkey, 'b.xsd', 1 from region",
}
